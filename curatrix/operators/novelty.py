"""Novelty of vectors against a corpus, and classes of pairs by cosine and entailment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.vectors import cosine, mean_vector
from curatrix.operators.similarity import nearest

LOCAL, CENTRE = 0.6, 0.3
SPECIFICITY = {"measurable": 1.0, "concrete": 0.8, "vague": 0.3}


def depth(rows: int, k: int | None = None) -> int:
    """How many neighbours to look at; grows with the corpus, unless k is given."""
    return k if k is not None else 1 if rows <= 50 else 3 if rows <= 200 else 5 if rows <= 1000 else 10


def decayed_mean(similarity: Column, age: Column | None, decay: float) -> Column:
    """Mean weighted by exp(-decay * age in days), a missing age counting as 0; the plain mean without decay or weight."""
    plain = F.avg(similarity)
    if age is None or decay <= 0:
        return plain
    w = F.exp(-decay * F.coalesce(age, F.lit(0.0)))
    return F.when(F.sum(w) < 1e-8, plain).otherwise(F.sum(similarity * w) / F.sum(w))


def weight(specificity: Column) -> Column:
    """Factor of a specificity level; unknown and null levels change nothing."""
    out = F.lit(1.0)
    for level, w in SPECIFICITY.items():
        out = F.when(specificity == level, w).otherwise(out)
    return out


def novelty(queries: DataFrame, corpus: DataFrame, k: int | None = None, category: str | None = None, centroid: bool = False, ages: DataFrame | None = None, decay: float = 0.0, specificity: str | None = None) -> DataFrame:
    """(query_id, novelty) in [0, 1] of queries(query_id, vec, ...) against corpus(id, vec, ...).

    1 minus the mean similarity to the nearest rows; with category (a column of both tables) mixed
    with the same inside the query's own category (1 if that has no rows; null categories are none);
    with centroid mixed with the distance from the corpus mean. ages(id, age): days, for decay. The
    neighbours' number comes from the whole corpus even inside a category. An empty corpus makes
    everything new. A query that is itself in the corpus sees itself.
    """
    rows = corpus.where("vec is not null and id is not null").count()
    if not rows:
        return queries.select("query_id", F.lit(1.0).alias("novelty"))
    n = depth(rows, k)

    def far(near: DataFrame, name: str) -> DataFrame:
        if ages is not None:
            near = near.join(ages.select("id", F.col("age").cast("double").alias("age")), "id", "left")
        return near.groupBy("query_id").agg((1 - decayed_mean(F.col("score"), F.col("age") if ages is not None else None, decay)).alias(name))

    out = queries.join(far(nearest(queries.select("query_id", "vec"), corpus.select("id", "vec"), n, digits=12), "g"), "query_id", "left")
    value = F.coalesce("g", F.lit(1.0))
    if category:
        known = lambda df, id: df.where(F.col(category).isNotNull()).select(id, "vec", category)
        out = out.join(far(nearest(known(queries, "query_id"), known(corpus, "id"), n, group=category, digits=12), "l"), "query_id", "left")
        value = F.when(F.col(category).isNull(), value).otherwise((1 - LOCAL) * value + LOCAL * F.coalesce("l", F.lit(1.0)))
    if centroid:
        out = out.crossJoin(F.broadcast(mean_vector(corpus.where("vec is not null"))))  # one row
        value = (1 - CENTRE) * value + CENTRE * (1 - cosine(F.col("vec"), F.col("centroid")))
    if specificity:
        value = value * weight(F.col(specificity))
    return out.select("query_id", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("novelty"))


def held(age: Column, decay: float) -> Column:
    """What decay leaves of a similarity at that age, a missing one counting as 0."""
    return F.exp(-decay * F.coalesce(age.cast("double"), F.lit(0.0)))


def mean_of_best(best: DataFrame) -> DataFrame:
    """(query_id, novelty) of best(query_id, score), the decayed similarities that count."""
    return best.groupBy("query_id").agg((1 - F.avg("score")).alias("novelty"))


def decayed_before_ranking(pairs: DataFrame, k: int, decay: float) -> DataFrame:
    """(query_id, novelty): similarities are decayed first, then the k best are averaged; pairs(query_id, score, age)."""
    held = pairs.withColumn("d", F.col("score") * F.exp(-decay * F.coalesce("age", F.lit(0.0))))
    best = held.groupBy("query_id").agg(F.slice(F.reverse(F.sort_array(F.collect_list("d"))), 1, k).alias("d"))
    return best.select("query_id", (1 - F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")).alias("novelty"))


def pair_class(score: Column, entailment: Column, known: float = 0.85, extends: float = 0.6) -> tuple[Column, Column]:
    """(class, label kept) of a pair by cosine and its entailment label; labels are asked for from `extends` on."""
    kind = F.when(score < extends, "NEW").when(entailment == "contradiction", "NEW").when(entailment == "entailment", "KNOWN").when(score >= known, "KNOWN").otherwise("EXTENDS")
    return kind, F.when(score >= extends, entailment)


def argmax_label(logits: Column, labels: tuple[str, ...] = ("contradiction", "entailment", "neutral")) -> Column:
    """Label of the largest logit, the first on a tie."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(logits, F.array_max(logits)).cast("int"))


def recent_against_old(items: DataFrame, days: float = 7.0) -> DataFrame:
    """(id, recent, old): highest similarity to items of the last `days` before, and to earlier ones.

    items(id, grp, ts, vec). A range join inside each group; items without predecessors have nulls.
    """
    from curatrix.functions.vectors import dot

    b = items.select(F.col("grp").alias("g"), F.col("id").alias("b"), F.col("ts").alias("tb"), F.col("vec").alias("vb"))
    age = (F.unix_micros("ts") - F.unix_micros("tb")) / 86400e6
    joined = items.join(b, F.col("grp").eqNullSafe(F.col("g")) & (F.col("tb") < F.col("ts")), "left").withColumn("s", dot(F.col("vec"), F.col("vb")))
    return joined.groupBy("id").agg(F.max(F.when(age <= days, F.col("s"))).alias("recent"), F.max(F.when(age > days, F.col("s"))).alias("old"))
