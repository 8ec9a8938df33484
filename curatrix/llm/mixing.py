"""Mixing sources to target weights by the cube method.

Every document of a source gets the same inclusion probability, so that the expected tokens of each
source meet its target. The cube method then moves the vector of probabilities through the null
space of the balancing constraints (documents and tokens of the source stay as they are) until nearly
all probabilities are 0 or 1. Sources are cut into buckets by hash, so a large source is worked on in
many tasks; what a bucket can't settle, at most two documents, goes into buckets of such rests, level
by level, and the last two documents of a source are its landing problem.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import BROADCAST_IDS, by_ids
from curatrix.llm.lengths import with_lengths
from curatrix.session import dropped, stored

#: Documents in a bucket, about.
BUCKET = 20_000
#: Sources are weighted by their tokens to this power, unless weights are given.
TEMPERATURE = 0.7
#: Share of all tokens to keep, where the targets allow it.
SHARE = 0.5


def probabilities(totals: DataFrame, share: float) -> DataFrame:
    """totals (tokens, weight) with the source's inclusion probability: budget * weight / tokens, at most 1.

    What a source that is kept whole can't supply is handed to the others by their weights: the sources
    whose tokens per weight are below a level are kept whole, and the level is raised until the budget
    is met. Sources stay in a table, as they may be many; a step is one sum over it.
    """
    ratio = F.try_divide(F.col("tokens").cast("double"), F.col("weight"))
    budget, level = share * float(totals.agg(F.sum("tokens")).first()[0] or 0), -1.0
    while True:
        whole = (F.col("weight") > 0) & (ratio <= level)
        row = totals.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("kept"), F.sum(F.when((F.col("weight") > 0) & ~whole, F.col("weight"))).alias("open")).first()
        if not row.open:
            level = float("inf")
            break
        after = (budget - float(row.kept)) / row.open
        if after <= level * (1 + 1e-12):
            break
        level = after
    p = F.when(~(F.col("weight") > 0) | F.col("weight").isNull(), 0.0).when(F.col("tokens") <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.lit(level), ratio)))
    return totals.withColumn("probability", p)


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Probabilities moved to 0 or 1 while sum(p) and sum(p * x) stay; with land, the last two as well.

    Three documents that are still open span one direction that keeps both sums; a random step along
    it, fair in expectation, settles at least one of them. In landing the token total is given up
    first, then the document total.
    """
    p = p.astype(float).copy()
    eps = 1e-9
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    todo = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    todo.reverse()
    values, sizes = p.tolist(), x.astype(float).tolist()
    active: list[int] = []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) == 3:
            a, b, c = active
            v = [sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a]]
            if not (v[0] or v[1] or v[2]):
                v = [1.0, -1.0, 0.0]
        elif land and len(active) == 2:
            v = [1.0, -1.0]
        elif land and len(active) == 1:
            values[active[0]] = float(next(draws) < values[active[0]])
            break
        else:
            break
        up = down = float("inf")
        for i, d in zip(active, v, strict=True):
            if d > 0:
                up, down = min(up, (1 - values[i]) / d), min(down, values[i] / d)
            elif d < 0:
                up, down = min(up, values[i] / -d), min(down, (1 - values[i]) / -d)
        step = up if next(draws) < down / (up + down) else -down
        still = []
        for i, d in zip(active, v, strict=True):
            q = values[i] + step * d
            values[i] = 0.0 if q <= eps else 1.0 if q >= 1 - eps else q
            if 0.0 < values[i] < 1.0:
                still.append(i)
        active = still
    return np.array(values)


def _fly(seed: int, level: int, land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
        key = f"{seed}/{level}/{pdf.source.iloc[0]}/{pdf.bucket.iloc[0]}"
        rng = np.random.default_rng(xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")))
        return pdf.assign(p=flight(pdf.p.to_numpy(), pdf.n_tokens.to_numpy(), rng, land))

    return run


_SCHEMA = "doc_id long, source string, n_tokens long, probability double, p double, bucket long, h long, buckets long"


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, share: float = SHARE, temperature: float = TEMPERATURE, bucket: int = BUCKET, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, probability) of the documents drawn; 1 / probability is a document's weight.

    weights: relative target tokens of each source, a missing source counts as 0 and none of it is
    drawn. In each source the drawn documents differ from probability * documents by less than one,
    and their tokens from the target by the landing of two documents at most. Rows that repeat a
    doc_id are one document of their summed tokens and its first source in string order; a null
    source is a source of its own. Null and empty texts count 0 tokens and are drawn like others.
    Rows without doc_id are never drawn. Empty tables give no rows. Equal hashes are ordered by
    doc_id, so the same documents give the same draw, however they are partitioned.
    """
    spark: SparkSession = docs.sparkSession
    units = stored(with_lengths(docs).groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens")), "units")
    totals = units.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    if weights is None:
        totals = totals.withColumn("weight", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(temperature))).otherwise(1.0))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
        totals = totals.join(given, F.col("s").eqNullSafe(F.col("name")), "left").drop("name").fillna({"weight": 0.0})
    totals = stored(totals, "sources")
    plan = probabilities(totals, share).select("s", "probability", F.ceil(F.col("docs") / F.lit(bucket)).alias("buckets"))
    sources, most = plan.agg(F.count("*"), F.max("buckets")).first()
    h = F.xxhash64("doc_id", F.lit(seed))
    # Names may be long, so far fewer of them than ids are broadcast.
    joined = units.join(F.broadcast(plan) if sources <= BROADCAST_IDS // 10 else plan, F.col("source").eqNullSafe(F.col("s")))
    start = joined.select("doc_id", "source", "n_tokens", "probability", F.col("probability").alias("p"), F.pmod(h, F.col("buckets")).alias("bucket"), h.alias("h"), "buckets")
    chosen, todo, level, steps = start.where("p >= 1").drop("buckets"), start.where("p > 0 and p < 1"), 0, []
    while True:
        land = most is None or most <= 1
        flown = stored(todo.groupBy("source", "bucket").applyInPandas(_fly(seed, level, land), _SCHEMA), "flown")
        steps.append(flown)
        chosen = chosen.union(flown.where("p >= 1").drop("buckets"))
        if land:
            break
        # A bucket leaves two documents at most: the rests of a source fill a fraction of its buckets.
        fewer = F.ceil(F.col("buckets") * F.lit(2) / F.lit(bucket))
        todo = flown.where("p > 0 and p < 1").withColumn("buckets", fewer).withColumn("bucket", F.pmod("h", F.col("buckets")))
        most, level = -(-2 * most // bucket), level + 1
    out = stored(chosen.select("doc_id", "source", "n_tokens", "probability"), "mixed")
    dropped(units, totals, *steps)
    return out


def drawn(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns kept, whose document is drawn; mixed() says what becomes of nulls, repeats and empty tables."""
    return by_ids(docs, mixed(docs, **params).select("doc_id"), "left_semi")
