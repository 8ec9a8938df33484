"""Vector arithmetic on array columns, evaluated inside the JVM in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once, not once for each element of an inner lambda."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def unit(a: Column, least: float | None = None) -> Column:
    """a divided by its length; a zero vector stays zero, or with `least` the length counts as that at least."""

    def divide(n: Column) -> Column:
        length = F.when(n == 0, 1.0).otherwise(n) if least is None else F.greatest(n, F.lit(least))
        return F.transform(a, lambda x: x.cast("double") / length)

    return bound(norm(a), divide)


def truncated(a: Column, k: int) -> Column:
    """The first k dimensions, of length 1 again."""
    return unit(F.slice(a, 1, k))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def mean_vector(df: DataFrame, vec: str = "vec", by: list[str] | None = None) -> DataFrame:
    """(by..., centroid): element-wise mean, summed partially before the shuffle; no rows give no centroid."""
    by = by or []
    cells = df.select(*by, F.posexplode(vec).alias("pos", "x"))
    means = cells.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("centroid")
    return means.groupBy(*by).agg(line).where(F.size("centroid") > 0)
