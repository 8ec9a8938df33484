"""Evaluation studies: pair samples, cross-lingual retrieval, noise, and slices of scored pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators.batch import cumulative
from curatrix.operators.similarity import nearest


def evaluation_pairs(items: DataFrame, per_kind: int, seed: int = 0) -> DataFrame:
    """(a, b, kind) of items(id, grp, source): at most per_kind pairs each of one group, of one source but two groups, and of neither.

    A sample by hash: every row is paired with the eight rows next to it in hash order within its group,
    source or bucket, so no group is squared. Null groups and sources belong to no pair of that kind.
    """
    h = F.xxhash64("id", F.lit(seed))
    base = items.select("id", "grp", "source", h.alias("h")).where("id is not null")

    def neighbours(rows: DataFrame, key: Column, kind: str) -> DataFrame:
        line = Window.partitionBy(key).orderBy("h", "id")
        ahead = F.collect_list(F.struct("id", "grp", "source")).over(line.rowsBetween(1, 8))
        pairs = rows.withColumn("ahead", ahead).select(F.col("id").alias("x"), F.col("grp").alias("g"), F.col("source").alias("s"), F.explode("ahead").alias("y"))
        return pairs.select(F.least("x", "y.id").alias("a"), F.greatest("x", "y.id").alias("b"), F.lit(kind).alias("kind"), F.col("g").eqNullSafe(F.col("y.grp")).alias("same_group"), F.col("s").eqNullSafe(F.col("y.source")).alias("same_source"))

    one = neighbours(base.where("grp is not null"), F.col("grp"), "group")
    two = neighbours(base.where("source is not null"), F.col("source"), "source").where("not same_group")
    # Random pairs: rows are dealt to buckets by hash, so the window isn't one partition.
    three = neighbours(base, F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1024)), "random").where("not same_group and not same_source")
    found = one.unionByName(two).unionByName(three).where("a <> b").select("a", "b", "kind").distinct()
    pick = Window.partitionBy("kind").orderBy(F.xxhash64("a", "b", F.lit(seed)), "a", "b")
    return found.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= per_kind).drop("n")


def cross_lingual(left: DataFrame, right: DataFrame, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row (n, mrr, recall_1, ...): where left(id, vec) finds the row of right that has its own id, among the 10 nearest."""
    near = nearest(left.select(F.col("id").alias("query_id"), "vec"), right.select("id", "vec"), max(10, *at))
    rank = near.where("query_id = id").select("query_id", "rank")
    joined = left.select(F.col("id").alias("query_id")).join(rank, "query_id", "left")
    return joined.agg(F.count("*").alias("n"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in at])


def noisy(vectors: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """vectors(id bigint, vec) with Gaussian noise, of length 1 again; a row's noise depends on its id and the seed alone."""

    @F.pandas_udf("array<double>")
    def run(ids: pd.Series, vecs: pd.Series) -> pd.Series:
        out = []
        for i, v in zip(ids, vecs, strict=True):
            if v is None:
                out.append(None)
                continue
            x = np.asarray(v, float) + np.random.default_rng([seed, int(i) & (2**63 - 1)]).normal(0, sigma, len(v))
            n = np.linalg.norm(x)
            out.append(x / n if n else x)
        return pd.Series(out)

    return vectors.withColumn("vec", run("id", "vec"))


def label_slices(pairs: DataFrame) -> DataFrame:
    """(quartile, label, n, mean): pairs(score, label) by quartile of the score, 1 the lowest; a score on an edge is in the lower slice."""
    edges = pairs.agg(F.expr("percentile(score, array(0.25, 0.5, 0.75))").alias("q"))
    place = F.size(F.filter("q", lambda e: e < F.col("score"))) + 1
    return pairs.where("score is not null").crossJoin(F.broadcast(edges)).groupBy(place.alias("quartile"), "label").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def alignment(pairs: DataFrame, near: float, new: float) -> DataFrame:
    """(class, n, cosine, novelty, cosine_std, novelty_std): pairs(cosine, novelty) by whether the two measures agree."""
    kind = F.when((F.col("cosine") >= near) & (F.col("novelty") < new), "both_known").when((F.col("cosine") < near) & (F.col("novelty") >= new), "both_new").when(F.col("cosine") >= near, "near_but_new").otherwise("far_but_known")
    return pairs.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.avg("cosine").alias("cosine"), F.avg("novelty").alias("novelty"), F.stddev_pop("cosine").alias("cosine_std"), F.stddev_pop("novelty").alias("novelty_std"))


def every_nth(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Every n-th row of a global order, from the first one on."""
    return cumulative(rows.withColumn("_one", F.lit(1)), "_one", order, "_n").where((F.col("_n") - 1) % n == 0).drop("_one", "_n")


def balanced(rows: DataFrame, label: str, per_class: int, key: str = "id", seed: int = 0) -> DataFrame:
    """per_class rows of each class, those of smallest hash of key."""
    line = Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= per_class).drop("_n")
