"""Budgeted, resumable batch runs and tiers that hand on what they could not settle.

State is a table of events (item_id, seq, status, cost, metadata); the newest event of an item is its
state, costs add up, and metadata maps merge with later keys winning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.session import stored

DONE = ("done", "verified", "applied", "skipped")
EVENT = "item_id string, seq bigint, status string, cost double, metadata map<string,string>"
RESULT = "item_id string, status string, cost double, confidence double, findings array<string>, metadata map<string,string>"
STATUS = {"verified": "done", "flagged": "needs_review", "error": "error"}


def state(events: DataFrame) -> DataFrame:
    """(item_id, status, cost, metadata) folded over the events of each item in order of seq."""
    folded = events.groupBy("item_id").agg(F.max_by("status", "seq").alias("status"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.sort_array(F.collect_list(F.struct("seq", F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("m")))).alias("all"))
    entries = F.aggregate("all", F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda s, e: F.concat(F.filter(s, lambda x: ~F.exists(e["m"], lambda y: y["key"] == x["key"])), e["m"]))
    return folded.select("item_id", "status", "cost", F.map_from_entries(entries).alias("metadata"))


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count("*").alias("n"))


def pending(items: DataFrame, current: DataFrame, done: tuple[str, ...] = DONE) -> DataFrame:
    """items(id) whose state isn't one of done; repeats stay."""
    finished = current.where(F.col("status").isin(list(done))).select(F.col("item_id").cast("string").alias("_d"))
    return items.join(finished, F.col("id").cast("string") == F.col("_d"), "left_anti")


def cumulative(df: DataFrame, value: str, order: list, name: str, step: int = 50_000) -> DataFrame:
    """df with the running sum of value over one global order.

    Rows are range-partitioned by the order and numbered; sums of chunks are added up apart from the
    rows, so no task holds more than a chunk's rows or the list of chunks.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    chunk = placed.withColumn("_c", F.shiftright("_at", 33) * (2**33 // step + 1) + F.floor(F.col("_at").bitwiseAND(F.lit(2**33 - 1)) / step))
    totals = chunk.groupBy("_c").agg(F.sum(value).alias("_t"))
    before = totals.select("_c", F.coalesce(F.sum("_t").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inner = F.sum(value).over(Window.partitionBy("_c").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return chunk.withColumn("_r", inner).join(before, "_c").withColumn(name, F.col("_b") + F.col("_r")).drop("_c", "_at", "_r", "_b")


def budget_cut(results: DataFrame, budget: float, order: list, spent: float = 0.0) -> DataFrame:
    """results with running cost and committed: the prefix that stays within budget; nothing after the first excess is taken."""
    summed = cumulative(results.withColumn("_cost", F.coalesce("cost", F.lit(0.0))), "_cost", order, "running").drop("_cost")
    return summed.withColumn("running", F.col("running") + spent).withColumn("committed", F.col("running") <= budget)


def numbered_batches(items: DataFrame, order: list, size: int) -> DataFrame:
    """items with a batch number in their order."""
    return cumulative(items.withColumn("_one", F.lit(1)), "_one", order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_one", "_n")


Process = Callable[[pd.DataFrame], pd.DataFrame]


def _processed(items: DataFrame, process: Process, size: int) -> DataFrame:
    """Results of process on batches of items; a batch that raises gives an error result for each of its items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for pdf in batches:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size].reset_index(drop=True)
                try:
                    out = process(part)
                except Exception as error:  # a failing batch must not end the run; it is reported item by item
                    out = pd.DataFrame({"item_id": part.id.astype(str), "status": "error", "cost": 0.0, "metadata": [{"error": str(error)}] * len(part)})
                out = out.reindex(columns=names).astype(object)
                yield out.where(out.notna(), None)

    return items.mapInPandas(run, RESULT)


def run_batch(items: DataFrame, events: DataFrame, process: Process, budget: float | None = None, size: int = 20, wave: int = 2_000) -> DataFrame:
    """New events of processing the pending items(id, ...), in order of id.

    Work goes in waves of that many items; after each the running cost is cut at budget (a lifetime
    cap: costs of earlier events count), dropped items keep their old state, and the run ends there.
    """
    spark = items.sparkSession
    current = state(events)
    spent = current.agg(F.sum("cost")).first()[0] or 0.0
    seq = (events.agg(F.max("seq")).first()[0] or 0) + 1
    todo = stored(numbered_batches(pending(items, current), [F.col("id")], wave), "todo")
    waves = todo.agg(F.max("batch")).first()[0]
    out = spark.createDataFrame([], EVENT)
    for w in range((-1 if waves is None else waves) + 1):
        if budget is not None and spent >= budget:
            break
        results = stored(_processed(todo.where(F.col("batch") == w).drop("batch"), process, size), "results")
        if budget is not None:
            cut = stored(budget_cut(results, budget, [F.col("item_id")], spent), "cut")
            results = cut.where("committed")
        part = results.select("item_id", F.lit(seq).cast("bigint").alias("seq"), "status", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
        out = out.unionByName(part)
        spent += part.agg(F.sum("cost")).first()[0] or 0.0
        if budget is not None and not cut.where("not committed").isEmpty():
            break
    return out


def run_tiers(items: DataFrame, tiers: list[tuple[str, Process]], budget: float | None = None, escalate: Column | None = None, size: int = 20) -> DataFrame:
    """(item_id, status, cost, confidence, findings, tier) after every tier; flagged items go on to the next.

    budget is a lifetime cap over all tiers. status is mapped: verified is done, flagged needs_review.
    """
    wanted = (F.col("status").isin("flagged", "needs_review")) if escalate is None else escalate
    now, spent, out = items, 0.0, None
    for name, process in tiers:
        if budget is not None and spent >= budget:
            break
        results = stored(_processed(now, process, size), "tier")
        if budget is not None:
            results = stored(budget_cut(results, budget, [F.col("item_id")], spent).where("committed").drop("running", "committed"), "tier")
        results = results.withColumn("tier", F.lit(name))
        out = results if out is None else out.unionByName(results)
        spent += results.agg(F.sum("cost")).first()[0] or 0.0
        now = items.join(results.where(wanted).select(F.col("item_id").alias("_i")), F.col("id").cast("string") == F.col("_i"), "left_semi")
    mapped = F.col("status")
    for a, b in STATUS.items():
        mapped = F.when(F.col("status") == a, b).otherwise(mapped)
    return out.withColumn("status", mapped).select("item_id", "status", F.coalesce("cost", F.lit(0.0)).alias("cost"), "confidence", "findings", "tier")


def tier_status(results: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tier, status, n), one row: cost, remaining): remaining items have no settled result."""
    settled = results.where(F.col("status").isin(list(DONE))).select(F.col("item_id").alias("_i")).distinct()
    left = items.join(settled, F.col("id").cast("string") == F.col("_i"), "left_anti").agg(F.count("*").alias("remaining"))
    return results.groupBy("tier", "status").agg(F.count("*").alias("n")), results.agg(F.sum("cost").alias("cost")).crossJoin(left)


def status_line(counts: DataFrame) -> DataFrame:
    """(tier, summary): "status=n" sorted, joined by commas."""
    return counts.groupBy("tier").agg(F.array_join(F.sort_array(F.collect_list(F.concat("status", F.lit("="), F.col("n").cast("string")))), ", ").alias("summary"))


def timeout_for(size: Column, base: int = 30, scale: float = 1.0, most: int = 1800) -> Column:
    return F.least(F.greatest(F.lit(base), (F.lit(base) * size * scale).cast("int")), F.lit(most))


def model_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(model, input_tokens, output_tokens) with cost by prices(model, input, output) a million tokens; unknown models cost nothing."""
    joined = calls.join(prices.select("model", F.col("input").alias("_i"), F.col("output").alias("_o")), "model", "left")
    return joined.withColumn("cost", F.coalesce((F.col("input_tokens") * F.col("_i") + F.col("output_tokens") * F.col("_o")) / 1e6, F.lit(0.0))).drop("_i", "_o")
