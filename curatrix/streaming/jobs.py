"""The operators that grow by increments, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from curatrix.operators.clusters import Centroids
from curatrix.sources.audit import SCHEMA


def audit_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(folder)


def table_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def daily_summary(entries: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, tier, entries, cost) of entries(ts timestamp, tier, cost); later than `late` behind the newest is dropped."""
    tier = F.when(F.coalesce("tier", F.lit("")) == "", "unknown").otherwise(F.col("tier"))
    return entries.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), tier.alias("tier")).agg(F.count("*").alias("entries"), F.sum("cost").alias("cost")).select(F.col("w.start").alias("day"), "tier", "entries", "cost")


def append_by_day(entries: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, appended as JSON lines by day, once."""
    return entries.withColumn("dt", F.date_format("ts", "yyyyMMdd")).writeStream.format("json").partitionBy("dt").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_key(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, latest): the value of the newest row of each key so far, in update mode; of equally new ones the largest value."""
    return rows.groupBy(key).agg(F.max(F.struct(ts, value)).alias("m")).select(key, F.col(f"m.{value}").alias("latest"))


def first_per_key(rows: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def clustered(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(key, id, cluster) of rows(key string, id bigint, vec array<double>), each key clustered on its own.

    Inside a micro-batch rows count in order of id, so a stream gives what the batch operator gives
    if ids rise with arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = Centroids(threshold)
        if state.exists:
            raw, dim, counts = state.get
            model = Centroids(threshold, np.frombuffer(raw).reshape(-1, dim).copy(), list(counts))
        pdf = pd.concat(list(batches)).sort_values("id", kind="stable")
        out = pd.DataFrame({"key": key[0], "id": pdf.id, "cluster": [model.add(v) for v in pdf.vec]})
        if model.counts:
            state.update((model.centres.tobytes(), model.centres.shape[1], model.counts))
        yield out

    rows = rows.where("vec is not null").select("key", F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, id bigint, cluster int", "centres binary, dim int, counts array<int>", "append", GroupStateTimeout.NoTimeout)


def each_batch(rows: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """act on every new micro-batch, once each across restarts: a resumable batch run, an index that follows its files, scoring against a snapshot."""
    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_against(rows: DataFrame, snapshot: DataFrame, k: int, decay: float = 0.0) -> DataFrame:
    """Stream rows(query_id, vec) joined to the rows of a static snapshot(id, vec, age) on one key, with decayed similarity."""
    from curatrix.functions.vectors import dot

    both = rows.join(snapshot.select("key", "id", F.col("vec").alias("v2"), "age"), "key")
    return both.select("query_id", "id", (dot(F.col("vec"), F.col("v2")) * F.exp(-decay * F.coalesce("age", F.lit(0.0)))).alias("score"))
