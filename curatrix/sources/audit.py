"""Audit logs as JSON lines: sink, source, operations and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPERATION = "struct<type:string,ids:array<bigint>,field:string,_ts:string>"
SCHEMA = f"ts string, item_id string, action string, details struct<status:string,type:string,operations:array<{OPERATION}>>, cost double, tier string"


def stamped(entries: DataFrame) -> DataFrame:
    """entries with a missing ts set to now, in UTC."""
    return entries.withColumn("ts", F.coalesce("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")))


def append(entries: DataFrame, folder: str) -> None:
    """Entries appended as JSON lines below <folder>/dt=YYYYMMDD."""
    stamped(entries).withColumn("dt", F.regexp_replace(F.left("ts", F.lit(10)), "-", "")).write.mode("append").partitionBy("dt").json(folder)


def read(spark: SparkSession, path: str, glob: str = "*.json*", since: str | None = None) -> DataFrame:
    """Entries of all files that match; blank and malformed lines are skipped. since compares as a string, ISO times sort so."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").json(path)
    return rows if since is None else rows.where(F.col("ts") >= since)


def operations(entries: DataFrame, types: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """(item_id, type, ids, field, ts): each entry's operations, or the entry itself where it lists none.

    A missing type is "unknown"; types=None or empty keeps all. key (of these columns): only the
    latest operation of each key stays, of equally late ones the one that reads last.
    """
    own = F.array(F.struct(F.coalesce(F.col("details.type"), F.col("action")).alias("type"), F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("_ts")))
    listed = F.when(F.size(F.coalesce("details.operations", F.array().cast(f"array<{OPERATION}>"))) > 0, F.col("details.operations")).otherwise(own.cast(f"array<{OPERATION}>"))
    out = entries.select("item_id", F.col("ts").alias("entry_ts"), F.posexplode(listed).alias("pos", "o"))
    out = out.select("item_id", F.coalesce("o.type", F.lit("unknown")).alias("type"), "o.ids", "o.field", F.coalesce("o._ts", "entry_ts").alias("ts"), "pos")
    if types:
        out = out.where(F.col("type").isin(types))
    if key is not None:
        line = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("pos"), F.desc("item_id"))
        out = out.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")
    return out.drop("pos")


def operations_by_type(ops: DataFrame) -> DataFrame:
    return ops.groupBy("type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ts", "item_id", "ids", "field"))).alias("operations"))


def summary(entries: DataFrame) -> DataFrame:
    """(scope, value, entries, items, errors, cost): totals (scope "all"), by action and by tier, in one pass; an empty tier is "unknown"."""
    tier = F.when(F.coalesce("tier", F.lit("")) == "", "unknown").otherwise(F.col("tier"))
    failed = (F.col("action") == "error") | (F.coalesce(F.col("details.status"), F.lit("")) == "error")
    rows = entries.select(F.coalesce("action", F.lit("unknown")).alias("action"), tier.alias("tier"), "item_id", F.coalesce("cost", F.lit(0.0)).alias("cost"), failed.alias("failed"))
    sets = rows.groupingSets([[], [F.col("action")], [F.col("tier")]], F.col("action"), F.col("tier"))
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("entries"), F.count_distinct("item_id").alias("items"), F.count_if("failed").alias("errors"), F.sum("cost").alias("cost"))
    return out.select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "action").otherwise("tier").alias("scope"), F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("action")).otherwise(F.col("tier")).alias("value"), "entries", "items", "errors", "cost")
