"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from curatrix.llm import embedding_dedup, exact_topk, licenses, lm_scoring, mixing, near_dedup, packing, quality, token_counts, toxicity

LONG = "Licensed under the Apache License, Version 2.0. " + "lorem ipsum dolor sit amet " * 30_000
ROWS = [
    (1, "one two three four five six", "x", None), (2, None, "x", 1), (3, "", None, 1), (4, "   \n\t ", "y", 2), (5, LONG, "y", 3),
    (6, "one two three four five six", "x", 4), (6, "one two three four five six", "x", 4), (7, "Étïon \U0001f600 x" * 20, None, 5), (None, "no id at all here", "x", 6), (8, "word", "x", 7),
]
SCHEMA = "doc_id long, text string, source string, lang string"
CLASHES = ("keys", "size", "same", "a", "b", "m", "bucket", "node", "component", "group_id", "part", "bin", "piece", "offset", "h", "p", "n_words", "probability", "key", "grams", "gram", "pos", "license", "word", "words", "y", "toxic", "quality", "p_toxic", "p_quality", "keep", "score", "rank", "n", "w", "x", "mask", "entries", "query", "item_id", "v", "q", "e", "u", "s", "vec_a", "buckets", "_c")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, s, "en") for i, t, s, _ in ROWS], SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (5, 0, 0), (8, 7, 7)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("y", F.lit(3))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "three four"), (2, None), (3, ""), (None, "four"), (1, "word"), (4, "three four")], "item_id long, text string").withColumn("doc_id", F.lit(9)).withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.999, 0.04]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [float("inf"), 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_licenses(docs):
    got = ids(licenses.license_spans(docs), "doc_id", "license", "start_word", "covered")
    assert (5, "apache-2.0-notice", 0, 1.0) in got and {g[0] for g in got} == {5}


def test_quality(docs, labels):
    got = quality.quality(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert all(r.p_quality == r.p_quality and r.keep == (r.p_quality >= 0.5) for r in got)
    assert sorted(quality.with_quality(docs, labels).columns) == sorted(docs.columns)


def test_quality_without_labels(docs, labels):
    assert all(r.keep for r in quality.quality(docs, labels.where("false")).collect())


def test_toxicity(docs, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert not any(r.toxic for r in got)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 9


def test_toxicity_without_labels(docs):
    assert not any(r.toxic for r in toxicity.toxicity(docs).collect())


def test_topk_ties_and_repeats(docs, items):
    got = exact_topk.top_documents(docs, items, 2)
    # Documents 1, 6 and 6 tie: the lower id first; a repeated query id is ranked together.
    assert ids(got.where("item_id = 4"), "rank", "doc_id") == [(1, 1), (2, 6)]
    assert ids(got, "item_id", "rank") == [(1, 1), (1, 2), (4, 1), (4, 2)]


def test_packing(docs):
    got = packing.pack(docs, capacity=64)
    tokens = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == {i: n * (1 + (i == 6)) for i, n in tokens.items() if n}
    assert got.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= 64


def test_packing_of_repeated_long_rows(spark):
    """Full pieces of rows that repeat a doc_id are bins of their own."""
    long = "word " * 500
    df = spark.createDataFrame([(1, long), (1, long), (2, long)], "doc_id long, text string")
    bins = packing.pack(df, capacity=64).groupBy("bin_id").agg(F.sum("n_tokens").alias("n"))
    assert bins.agg(F.max("n")).first()[0] == 64 and bins.agg(F.sum("n")).first()[0] == 3 * token_counts.token_counts(df).first().n_tokens


def test_lm(docs):
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[2].bits_per_word is None and got[2].log_p == 0
    assert got[5].n_words == 150_008 and got[5].log_p < 0


def test_tokens(docs):
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert got[2] == got[3] == 0 and got[4] > 0 and got[8] == 1 and got[5] > 150_000


def test_embeddings(vectors):
    got = ids(embedding_dedup.near_duplicate_classes(vectors), "vec_id", "class_id", "links")
    assert got == [(1, 1, 2), (2, 1, 2), (3, 1, 1)]  # 1 and 2 are equal, and one of them is linked to 3


def test_mixing(docs):
    got = mixing.mixed(docs, share=1.0)
    assert ids(got, "doc_id") == [(i,) for i in range(1, 9)]
    assert {r.n_tokens for r in got.where("doc_id = 6").collect()} == {12}
    assert mixing.drawn(docs, share=1.0).columns == docs.columns


def test_mixing_ignores_sources_without_weight(docs):
    got = mixing.mixed(docs, weights={"x": 1.0, None: 0.0}, share=0.5)
    assert {r.source for r in got.collect()} <= {"x"}


def test_near_dedup(docs):
    assert ids(near_dedup.near_duplicate_groups(docs), "doc_id", "group_id") == [(1, 1), (6, 1)]
    again = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(1, "a smaller text than the other")], "doc_id long, text string"))
    assert ids(near_dedup.near_duplicate_groups(again), "doc_id", "group_id") == [(1, 1), (6, 1)]  # the largest text counts
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and ids(kept, "doc_id") == [(1,), (2,), (3,), (4,), (5,), (7,), (8,)]


@pytest.mark.parametrize("run", [
    lambda d, l, i, v: licenses.license_spans(d), lambda d, l, i, v: quality.quality(d, l), lambda d, l, i, v: exact_topk.top_documents(d, i), lambda d, l, i, v: packing.pack(d),
    lambda d, l, i, v: toxicity.toxicity(d, l), lambda d, l, i, v: lm_scoring.lm_scores(d), lambda d, l, i, v: token_counts.token_counts(d), lambda d, l, i, v: embedding_dedup.near_duplicate_classes(v),
    lambda d, l, i, v: mixing.mixed(d), lambda d, l, i, v: near_dedup.near_duplicate_groups(d), lambda d, l, i, v: near_dedup.without_near_duplicates(d), lambda d, l, i, v: toxicity.without_toxic(d, l),
])
def test_empty_tables(run, docs, labels, items, vectors):
    assert run(docs.where("false"), labels.where("false"), items.where("false"), vectors.where("false")).collect() == []


@pytest.mark.parametrize("run", [lambda d, i: exact_topk.top_documents(d, i.where("false")), lambda d, i: exact_topk.top_documents(d.where("false"), i), lambda d, i: licenses.license_spans(d, {}), lambda d, i: licenses.license_spans(d, {"short": "one two"})])
def test_nothing_to_look_for(run, docs, items):
    assert run(docs, items).collect() == []
