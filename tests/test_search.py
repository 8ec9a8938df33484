import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curatrix.functions.text import Porter, field_value, genericized, outline, parsed_value, query_tokens, reference_parts, sentences, slug
from curatrix.functions.vectors import cosine, dot, mean_vector, norm, truncated, unit
from curatrix.operators import search
from curatrix.operators.similarity import harness_rows, nearest, similar_pairs, top, triage

VEC2 = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [math.sqrt(0.5)] * 2)]


@pytest.fixture(scope="module")
def vec2d(spark):
    return spark.createDataFrame(VEC2, "id long, vec array<double>")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(dot("a", "a").alias("d") if False else dot(F.col("a"), F.col("a")).alias("d"), norm(F.col("a")).alias("n"), unit(F.col("a")).alias("u"), unit(F.col("z")).alias("z"), unit(F.col("z"), 1e-8).alias("g"), cosine(F.col("a"), F.col("z")).alias("c"), truncated(F.col("a"), 1).alias("t")).first()
    assert (r.d, r.n, r.u, r.z, r.g, r.c, r.t) == (25.0, 5.0, [0.6, 0.8], [0.0, 0.0], [0.0, 0.0], 0.0, [1.0])


def test_mean_vector(vec2d):
    assert mean_vector(vec2d).first().centroid == pytest.approx([0.6767767, 0.4267767])
    assert mean_vector(vec2d.where("false")).collect() == []


@pytest.mark.parametrize("block", [1, 2, 100])
def test_pairs_at_a_threshold(vec2d, block):
    got = similar_pairs(vec2d, 0.7, block=block)
    assert sorted((a, b, round(s, 4)) for a, b, s in rows(got, "a", "b", "score")) == [(1, 2, 1.0), (1, 4, 0.7071), (2, 4, 0.7071), (3, 4, 0.7071)]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_pairs_by_group(spark, block):
    df = spark.createDataFrame([(i, v, g) for (i, v), g in zip(VEC2, ["x", None, None, "x"])], "id long, vec array<double>, g string")
    assert sorted(rows(similar_pairs(df, 0.7, group="g", groups="cross", block=block), "a", "b")) == [(1, 2), (2, 4), (3, 4)]
    assert sorted(rows(similar_pairs(df, 0.0, group="g", groups="within", block=block), "a", "b")) == [(1, 4), (2, 3)]


@pytest.mark.parametrize("block", [1, 2, 100])
def test_nearest_breaks_ties_by_id(vec2d, block):
    q = vec2d.withColumnRenamed("id", "query_id")
    got = nearest(q, vec2d, 2, block=block).where("query_id = 1")
    assert rows(got, "id", "rank") == [(1, 1), (2, 2)]
    got = nearest(q, vec2d, 2, others=True, block=block).where("query_id = 4").orderBy("rank")
    assert rows(got, "id", "score") == [(1, 0.707107), (2, 0.707107)]


def test_nearest_of_empty_and_null(spark, vec2d):
    q = vec2d.withColumnRenamed("id", "query_id")
    assert nearest(q, vec2d.where("false"), 3).count() == 0
    assert nearest(q.where("false"), vec2d, 3).count() == 0
    holes = spark.createDataFrame([(9, None), (None, [1.0, 0.0])], "id long, vec array<double>")
    assert nearest(q, vec2d.union(holes), 10).where("id = 9 or id is null").count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("b", [1.0]), ("a", [1.0])], "id string, vec array<double>")
    assert rows(similar_pairs(df, 0.5), "a", "b") == [("a", "b")]


def test_triage_and_harness(spark):
    pairs = spark.createDataFrame([(1, 2, 0.92), (1, 5, 0.525), (3, 4, 0.15), (4, 5, 0.75), (5, 6, 0.3)], "a long, b long, score double")
    got = {(r.a, r.b): (r.classification, round(r.confidence, 4)) for r in triage(pairs).collect()}
    assert got == {(1, 2): (True, 1.0), (1, 5): (None, 0.0), (3, 4): (False, 1.0), (4, 5): (True, 1.0), (5, 6): (None, 1.0)}
    texts = spark.createDataFrame([(1, "one"), (5, "five")], "id long, text string")
    assert rows(harness_rows(triage(pairs).where("classification is null"), texts), "id", "content", "output", "context") == [("pair_1_5", "one", "five", "cosine=0.525")]


DOCS = [("a", "the cat sat on the mat"), ("b", "the dog sat"), ("c", "a cat and a dog"), ("d", "birds fly"), ("e", "CAT cat cat"), ("f", None)]


def brute_bm25(docs, query):
    split = {i: (t or "").lower().split() for i, t in docs}
    n, average = len(split), sum(map(len, split.values())) / len(split)
    out = {}
    for i, w in split.items():
        s = 0.0
        for t in query:
            df = sum(t in x for x in split.values())
            idf = math.log((n - df + 0.5) / (df + 0.5)) if df else 0
            s += (idf if idf > 0 else 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) if w.count(t) else 0
        if s:
            out[i] = s
    return out


def test_bm25_as_the_formula(spark):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    q = spark.createDataFrame([(1, "cat dog cat"), (2, "a 7 42"), (3, None), (4, "cat the sat fly")], "query_id long, text string")
    got = search.bm25(q, docs, None)
    assert {r.id: r.score for r in got.where("query_id = 1").collect()} == pytest.approx(brute_bm25(DOCS, ["cat", "dog", "cat"]))
    assert {r.id: r.score for r in got.where("query_id = 4").collect()} == pytest.approx(brute_bm25(DOCS, ["cat", "the", "sat", "fly"]))
    assert got.where("query_id in (2, 3)").count() == 0


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_in_two_passes_as_by_joins(spark, monkeypatch, stem):
    """Scores, ties and the best of each source are the same; no posting is shuffled."""
    words = ["cat", "cats", "dog", "sat", "mat", "bird", "birds", "flying"]
    docs = spark.createDataFrame([(i, " ".join(words[(i * 7 + j * j) % 8] for j in range(i % 6)) or None, None if i % 5 == 0 else f"s{i % 3}") for i in range(40)], "id long, text string, source string").repartition(5)
    q = spark.createDataFrame([(1, "cat dog cat"), (2, "birds"), (3, "mat fly sat cats")], "query_id long, text string")
    run = lambda limit, by: sorted((tuple(r) for r in search.bm25(q, docs, limit, stem, 6, by).select("query_id", "rank", "id", "score", *([by] if by else [])).collect()), key=repr)
    cases = [(None, None), (3, None), (None, "source"), (2, "source")]
    got = [run(*c) for c in cases]
    plan = search.bm25(q, docs, 3, stem, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan
    monkeypatch.setattr(search, "ASKED", 1)
    assert got == [run(*c) for c in cases] and all(got)


def test_stemming_and_folding(spark):
    docs = spark.createDataFrame([(1, "Running in the café"), (2, "cars"), (3, "nothing"), (4, "else"), (5, "more")], "id long, text string")
    q = spark.createDataFrame([(1, "runs cafe"), (2, "car")], "query_id long, text string")
    assert sorted(rows(search.bm25(q, docs, None, stem=True), "query_id", "id")) == [(1, 1), (2, 2)]


def test_porter():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "formalize": "formal", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "is": "is"}
    assert {w: Porter.stem(w) for w in want} == want


def lists(spark):
    one = lambda ids, s: spark.createDataFrame([(1, i, x, n + 1) for n, (i, x) in enumerate(zip(ids, s))], "query_id long, id string, score double, rank int")
    return one("ab", [0.9, 0.5]), one("bc", [7.0, 3.0])


def test_fusion(spark):
    dense, sparse = lists(spark)
    got = {r.id: (r.rank, r.score) for r in search.rrf(dense, sparse).collect()}
    assert got["b"] == (1, pytest.approx(1 / 62 + 1 / 61)) and got["a"] == (2, pytest.approx(1 / 61)) and got["c"] == (3, pytest.approx(1 / 62))
    assert {r.id: r.score for r in search.convex(dense, sparse, 0.6).collect()} == pytest.approx({"a": 0.6, "b": 0.4, "c": 0.0})
    assert search.rrf_sweep(dense, sparse, [1, 100]).where("k = 1 and id = 'b'").first().score == pytest.approx(1 / 3 + 1 / 2)
    swapped = rows(search.rrf(sparse, dense), "id", "rank")
    assert sorted(swapped) == sorted(rows(search.rrf(dense, sparse), "id", "rank"))


def test_hybrid_allow_list(spark):
    docs = spark.createDataFrame([(i, t, v) for (i, v), t in zip(VEC2, ["red fox", "red hen", "blue fox", None])], "id long, text string, vec array<double>")
    q = spark.createDataFrame([(1, "red", [1.0, 0.0])], "query_id long, text string, vec array<double>")
    assert rows(search.hybrid(q, docs).orderBy("rank"), "id")[:2] == [(1,), (2,)]
    allow = spark.createDataFrame([(2,), (3,)], "id long")
    for pre in (False, True):
        assert sorted(rows(search.hybrid(q, docs, allow=allow, prefilter_text=pre), "id")) == [(2,), (3,)]


def test_grep(spark):
    docs = spark.createDataFrame([(1, "50% off"), (2, "Fifty OFF"), (3, None), (4, "5000 off")], "id long, content string")
    assert rows(search.grep(docs, "off"), "id") == [(1,), (2,), (4,)]
    assert sorted(rows(search.grep(docs, "50%off", None), "id")) == [(1,), (4,)]
    assert rows(search.grep(docs, "50%", None, literal=True), "id") == [(1,)]
    assert search.grep(docs, "  ").count() == 0


def test_dedup_hydrate_rerank(spark):
    results = spark.createDataFrame([(1, "a", 0.9, 1, "q", "x"), (1, "b", 0.8, 2, "q", "xxx"), (1, "c", 0.7, 3, "q", "xx"), (1, "d", 0.6, 4, "q", "xxxxxx")], "query_id long, id string, score double, rank int, query string, content string")
    assert rows(search.first_per_key(results, F.col("id").isin("a", "b")).orderBy("rank"), "id") == [("a",), ("c",)]
    got = search.reranked(results, lambda q, c: c.str.len() * 1.0, first=3).orderBy("rank")
    assert rows(got, "id", "score") == [("b", 3.0), ("c", 2.0), ("a", 1.0), ("d", 0.6)]
    with pytest.raises(Exception, match="rerank needs content"):
        search.reranked(results.withColumn("content", F.lit("")), lambda q, c: pd.Series([0.0] * len(q))).collect()
    known = spark.createDataFrame([("a", "text", "{}")], "id string, content string, metadata string")
    short = results.select("query_id", "id")
    assert sorted(rows(search.hydrated(short, known), "id", "content")) == [("a", "text"), ("b", ""), ("c", ""), ("d", "")]
    assert rows(search.hydrated(short, known, inner=True), "id") == [("a",)]


def test_expanded_query(spark, vec2d):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    got = search.expanded(q, vec2d.where("id = 3"), 1, 0.7).first().vec
    assert got == pytest.approx([0.7 / math.hypot(0.7, 0.3), 0.3 / math.hypot(0.7, 0.3)])


def test_top_ties(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 9, 0.7)], "query_id long, id long, score double")
    assert rows(top(df, 2).orderBy("rank"), "id") == [(9,), (2,)]


def test_text_functions(spark):
    text = "See https://x.org/a?b=1 or a.b@c.de on 2024-01-02, 3/4/21, March 2020, in 2019-2020 and 1999: 45.5% of $3 million or 1,200 cats"
    df = spark.createDataFrame([(text, "a  7 42 é_x Ünd b")], "t string, q string")
    r = df.select(genericized(F.col("t")).alias("g"), query_tokens(F.col("q")).alias("w")).first()
    assert r.g == "See [URL] or [EMAIL] on [DATE], [DATE], [DATE], in [YEAR] and [YEAR]: [PERCENT] of [AMOUNT] or [NUM] cats"
    assert r.w == ["é_x", "ünd"]
    r = df.select(slug(F.lit("id1"), F.lit("Merge: Ünit 7/8 & more")).alias("s"), F.size(sentences(F.lit("One. Two.  . Three"))).alias("n"), outline(F.lit(2), F.lit("T"), F.lit("d")).alias("o"), reference_parts(F.lit("work/a/b")).alias("p")).first()
    assert (r.s, r.n, r.o, tuple(r.p)) == ("id1_merge_ünit_78__more", 3, "  - T: d", ("work", "a/b"))
    with pytest.raises(Exception, match="not a type/id reference"):
        df.select(reference_parts(F.lit("work"))["id"].alias("x")).collect()


def test_literals(spark):
    want = {"[1, 'a']": ("array", '[1, "a"]'), '{"k": 1}': ("object", '{"k": 1}'), " 42 ": ("integer", "42"), "True": ("boolean", "true"), "None": ("null", None), "1.5": ("string", '"1.5"'), "[broken": ("string", '"[broken"')}
    assert {k: field_value(k) for k in want} == want
    df = spark.createDataFrame([("7",), (None,)], "raw string")
    assert [tuple(r.v) for r in df.select(parsed_value(F.col("raw")).alias("v")).collect()] == [("integer", "7"), ("null", None)]
