"""Similar documents from several weighted text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.vectors import bound, scaled, unit
from curatrix.operators.similarity import similar_pairs


def field_text(texts: Column, field: str, order: Column) -> Column:
    """texts[field], else the first non-empty text in the given order of fields, else null."""
    own = F.when(F.length(texts[field]) > 0, texts[field])
    others = F.filter(F.transform(order, lambda f: texts[f]), lambda t: F.length(F.coalesce(t, F.lit(""))) > 0)
    return F.coalesce(own, F.get(others, F.lit(0)))


def combined(weights: dict[str, float]) -> Column:
    """Unit vector of the weighted unit vectors in columns vec_<field>; null if any of them is null."""
    total = sum(weights.values())
    if not weights or total <= 0:
        raise ValueError("fields need a positive total weight")
    if len(weights) == 1:
        return unit(F.col(f"vec_{next(iter(weights))}"))
    out = None
    for field, w in weights.items():
        share = F.lit(w / total)
        part = bound(unit(F.col(f"vec_{field}")), lambda v: scaled(v, share))  # noqa: B023
        out = part if out is None else F.zip_with(out, part, lambda x, y: x + y)
    return bound(out, unit)


def similar_documents(docs: DataFrame, weights: dict[str, float], threshold: float = 0.52, most: int | None = None) -> DataFrame:
    """(a, b, score, field_scores) of docs(id, vec_<field>...), best first, scores rounded to 4 places.

    The threshold is held against the exact score. field_scores has one entry a field, and is empty
    with a single field. Documents with a missing field vector are left out.
    """
    units = docs.select("id", combined(weights).alias("vec"), *[unit(F.col(f"vec_{f}")).alias(f"u_{f}") for f in weights])
    fields = [f"u_{f}" for f in weights] if len(weights) > 1 else []
    # The fields' vectors travel with their rows, not with the pairs.
    pairs = similar_pairs(units, threshold, carry=tuple(fields))
    scores = F.create_map(*[x for f in weights for x in (F.lit(f), F.round(f"u_{f}", 4))]) if fields else F.expr("cast(map() as map<string, double>)")
    pairs = pairs.select("a", "b", "score", scores.alias("field_scores"))
    out = pairs.withColumn("score", F.round("score", 4))
    return out if most is None else out.orderBy(F.desc("score"), "a", "b").limit(most)
