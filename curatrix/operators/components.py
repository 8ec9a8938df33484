"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.session import dropped, stored


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
    return both.withColumn("m", low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    ends = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return low.select(ends.alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node id.

    edges(a, b): undirected bigint pairs. Self loops and rows with a null end are ignored,
    repeated and reversed edges count once, no edges give no rows. Each round is written to
    the shared folder, so a lost executor costs at most one round.
    """
    now = stored(_pairs(edges).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        after = stored(_small(_large(now)), "cc")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        dropped(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
