import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import clusters, docsim, embedding, graphs, novelty, similarity, whitening
from curatrix.operators.components import connected_components


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def units(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_of(x, t):
    s = x @ x.T
    return {i: {j for j in range(len(x)) if j != i and s[i, j] >= t} for i in range(len(x)) if (s[i] >= t).sum() > 1}


def test_rows_travel_a_fixed_number_of_times(spark):
    """A table is cut into at most CUTS blocks while they stay small, so the grid's shuffle grows with the rows, not with their square."""
    x = similarity._prepared(spark.range(60_000).select("id", F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("vec")), "id", None, False)
    blocks, cuts = similarity._packed(x, similarity.BLOCK)
    assert cuts.first().cuts == blocks.count() == similarity.CUTS
    assert blocks.select(F.max(F.length(F.col("ms")[0]))).first()[0] < 1.1 * 60_000 / similarity.CUTS * 8  # as narrow as the column


@pytest.mark.parametrize("block", [5, 2_048])
def test_grid_as_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(similarity, "STRIPE", 40)
    x, other = units(60, 3, 5), units(60, 4, 6)
    s = np.round(x @ x.T, 9)
    df = spark.createDataFrame([(i, v.tolist(), o.tolist(), None if i % 7 == 0 else i % 3, 1.0 + i % 4) for i, (v, o) in enumerate(zip(x, other, strict=True))], "id long, vec array<double>, more array<double>, g int, w double")
    want = {(i, j): (round(float(other[i] @ other[j]), 9), i % 3 == j % 3 and i % 7 != 0 and j % 7 != 0) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.6}
    found = similarity.similar_pairs(df, 0.6, group="g", groups="mark", carry=("more",), block=block).collect()
    assert {(r.a, r.b): (round(r.more, 9), r.same) for r in found} == want and len(found) == len(want)
    # Ties at the k-th place go by id, in every block.
    tied = df.withColumn("vec", F.when(F.col("id") < 30, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.col("vec")))
    y = np.where(np.arange(60)[:, None] < 30, [[1.0, 0.0, 0.0]], x)
    best = similarity.nearest(tied.withColumnRenamed("id", "query_id"), tied, 4, others=True, block=block).collect()
    got = {}
    for r in sorted(best, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: sorted((j for j in range(60) if j != i), key=lambda j: (-round(float(y[i] @ y[j]), 6), j))[:4] for i in range(60)}  # noqa: B023


@pytest.mark.parametrize("most", [3, 50])
@pytest.mark.parametrize("kind", ["greedy", "complete"])
def test_clusters_by_component_equal_one_pass(spark, kind, most):
    x = units(120, 4, 1)
    want = sorted(getattr(clusters, kind)(near_of(x, 0.85), most))
    run = clusters.greedy_clusters if kind == "greedy" else clusters.complete_linkage_clusters
    got = {}
    for r in run(frame(spark, x), 0.85, most).orderBy("cluster_id", "position").collect():
        got.setdefault(r.cluster_id, []).append(r.member_id)
    assert sorted(got.values()) == want
    if kind == "complete":
        assert all((x[c] @ x[c].T >= 0.85 - 1e-12).all() for c in got.values())


@pytest.mark.parametrize("kind", ["greedy", "complete"])
def test_clusters_hold_no_pairs(spark, monkeypatch, kind):
    """A component's task gets a row for each vector, of which all are neighbours, and takes several turns of seeds."""
    monkeypatch.setattr(clusters, "similar_pairs", None)
    x = units(700, 3, 4)
    near = near_of(x, 0.5)
    got = {}
    run = clusters.greedy_clusters if kind == "greedy" else clusters.complete_linkage_clusters
    for r in run(frame(spark, x), 0.5, 7).orderBy("cluster_id", "position").collect():
        got.setdefault(r.cluster_id, []).append(r.member_id)
    assert sorted(got.values()) == sorted(getattr(clusters, kind)(near, 7)) and len(got) > clusters.Near.SEEDS


def test_giant_component_is_reported(spark):
    with pytest.raises(ValueError, match="a component of 5 rows"):
        clusters.greedy_clusters(frame(spark, np.ones((5, 2)) / math.sqrt(2)), 0.9, largest=4)


def test_incremental(spark):
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [0, 0]], float)
    got = clusters.incremental_clusters(frame(spark, x), 0.9).orderBy("id").collect()
    assert [r.cluster for r in got] == [0, 0, 1, 1, 2]
    keyed = clusters.incremental_clusters(frame(spark, x).withColumn("g", F.col("id") % 2), 0.9, key="g")
    assert {(r.id, r.cluster) for r in keyed.collect()} == {(0, 0), (2, 1), (4, 2), (1, 0), (3, 1)}


def test_cluster_statistics(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)], "cluster_id long, member_id long")
    r = clusters.cluster_sizes(c).first()
    assert (r.clusters, r.mean, r.median, r.largest, r.smallest, r.p90) == (2, 2.5, 2.5, 3, 2, pytest.approx(2.9))
    pairs = clusters.together(c)
    some = spark.createDataFrame([(1, 2), (1, 9)], "a long, b long")
    assert clusters.pair_agreement(some, pairs).first().agreement == 0.5
    assert clusters.pair_agreement(some.where("false"), pairs).first().agreement == 1.0


def test_marked_agreement_and_spanning_pairs(spark):
    x = units(80, 3, 8)
    df = spark.createDataFrame([(i, v.tolist(), None if i == 5 else i % 4) for i, v in enumerate(x)], "id long, vec array<double>, g int")
    pairs = similarity.similar_pairs(df, 0.85)
    same = clusters.together(df.select(F.col("g").alias("cluster_id"), F.col("id").alias("member_id")))
    marked = similarity.similar_pairs(df, 0.85, group="g", groups="mark", block=16)
    assert clusters.marked_agreement(marked).first().agreement == pytest.approx(clusters.pair_agreement(pairs, same).first().agreement)
    assert clusters.marked_agreement(marked.where("false")).first().agreement == 1.0
    # A forest of each cell, not all of its pairs, joins the same components.
    forest = similarity.spanning_pairs(df, 0.6, block=16)
    assert sorted(connected_components(forest).collect()) == sorted(connected_components(similarity.similar_pairs(df, 0.6)).collect())
    assert similarity.spanning_pairs(df, 0.6).count() < 80 < similarity.similar_pairs(df, 0.6).count()
    near = near_of(x, 0.6)
    assert {r.id: r.degree for r in similarity.degrees(df, 0.6, block=16).collect()} == {i: len(n) for i, n in near.items()}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {i: root(i) for i in parent}
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.where("false")).count() == 0


def graph(spark):
    e = [(1, 2), (2, 3), (3, 4), (2, 5), (6, 7)]
    return spark.createDataFrame([*e, *[(b, a) for a, b in e]], "a long, b long"), spark.createDataFrame([(i,) for i in range(1, 9)], "id long")


def test_graph_operators(spark):
    edges, nodes = graph(spark)
    r = graphs.degree_stats(edges, nodes).first()
    assert (r.edges, r.mean, r.median, r.largest, r.isolated) == (5, 1.25, 1.0, 3, 1)
    seeds = spark.createDataFrame([(1,), (8,)], "seed long")
    assert sorted(tuple(x) for x in graphs.neighbourhood(edges, seeds, 2).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 5, 2), (8, 8, 0)]
    want = spark.createDataFrame([(1, 4), (1, 6), (5, 5), (4, 5)], "source long, target long")
    assert {(x.source, x.target): x.path for x in graphs.shortest_paths(edges, want).collect()} == {(1, 4): [1, 2, 3, 4], (5, 5): [5], (4, 5): [4, 3, 2, 5]}
    # All pairs counted from both ends: node 2 lies between 1-3, 1-4, 1-5, 3-5 and 4-5.
    got = {x.node: x.score for x in graphs.betweenness(edges, nodes).collect()}
    assert got[2] == 10.0 and got[3] == 6.0 and got[1] == got[8] == 0.0
    labels = {x.node: x.label for x in graphs.label_propagation(edges, nodes).collect()}
    assert len(labels) == 8 and labels[8] == 8 and {labels[6], labels[7]} <= {6, 7}
    now, links = {i: i for i in range(1, 9)}, [tuple(e) for e in edges.collect()]
    for _ in range(20):
        votes = {i: [now[b] for a, b in links if a == i] for i in now}
        now = {i: min(v, key=lambda x: (-v.count(x), x)) if v else now[i] for i, v in votes.items()}  # noqa: B023
    assert labels == now
    g = spark.createDataFrame([(1, 2), (1, 3)], "seed long, node long")
    v = spark.createDataFrame([(1, 3), (1, 4), (1, 5)], "seed long, node long")
    assert tuple(graphs.found_by(g, v).first()) == (1, 1, 1, 2, 0.25)


def test_graph_walks_over_many_pieces(spark, monkeypatch):
    """Nodes' links lie in pieces of a few; walks, labels and betweenness over all of them are those of brute force, without a limit of links."""
    monkeypatch.setattr(graphs.Adjacency, "PIECE", 7)
    rng = np.random.default_rng(2)
    near = {i: set() for i in range(50)}
    for a, b in rng.integers(0, 45, (60, 2)).tolist():
        if a != b:
            near[a].add(b)
            near[b].add(a)
    rows = [(10 * a, 10 * b) for a in near for b in near[a]]
    edges = spark.createDataFrame(rows + rows[:5], "a long, b long")
    nodes = spark.createDataFrame([(10 * i,) for i in near], "id long")
    assert len(graphs.Adjacency(edges).first) > 10 and graphs.Adjacency(edges).links() == len(rows)
    every = {}
    for s in near:
        every[s] = {s: [s]}
        front = [s]
        while front:
            more = {}
            for v in sorted(front, key=lambda v: every[s][v]):  # noqa: B023
                for w in sorted(near[v] - set(every[s])):
                    more.setdefault(w, [*every[s][v], w])
            every[s].update(more)
            front = list(more)
    got = {(r.seed // 10, r.node // 10): r.depth for r in graphs.neighbourhood(edges, nodes.withColumnRenamed("id", "seed"), 3).collect()}
    assert got == {(s, v): len(p) - 1 for s in near for v, p in every[s].items() if len(p) <= 4}
    pairs = spark.createDataFrame([(10 * a, 10 * b) for a in near for b in range(0, 50, 3)], "source long, target long")
    want = {(a, b): every[a][b] for a in near for b in range(0, 50, 3) if b in every[a]}
    assert {(r.source // 10, r.target // 10): [x // 10 for x in r.path] for r in graphs.shortest_paths(edges, pairs).collect()} == want
    assert {(r.source // 10, r.target // 10): r.steps for r in graphs.path_lengths(edges, pairs, 4).collect()} == {k: len(p) - 1 for k, p in want.items() if len(p) <= 5}
    vector = pairs.selectExpr("source as seed", "target as node").where("seed <> node")
    graph = graphs.neighbourhood(edges, nodes.withColumnRenamed("id", "seed"), 2).where("depth > 0")
    assert sorted(graphs.neighbourhood_against(edges, vector, 2).collect()) == sorted(graphs.found_by(graph, vector).collect())
    now = {i: i for i in near}
    for _ in range(20):
        votes = {i: [now[b] for b in near[i]] for i in near}
        now = {i: min(v, key=lambda x: (-v.count(x), x)) if v else now[i] for i, v in votes.items()}  # noqa: B023
    assert {r.node // 10: r.label // 10 for r in graphs.label_propagation(edges, nodes).collect()} == now
    # Of all shortest paths between two nodes, the share that goes through a third.
    n = lambda a, b: 1 if a == b else sum(n(a, v) for v in near[b] if len(every[a][v]) == len(every[a][b]) - 1)
    through = {v: sum(n(a, v) * n(v, b) / n(a, b) for a in near for b in every[a] if a != v != b and a != b and v in every[a] and len(every[a][v]) + len(every[v][b]) - 1 == len(every[a][b])) for v in near}
    assert {r.node // 10: round(r.score, 6) for r in graphs.betweenness(edges, nodes).collect()} == pytest.approx(through, abs=1e-5)


# Novelty


def two(spark, rows, cols="vec array<double>"):
    return spark.createDataFrame(rows, f"id long, {cols}")


def score(df):
    return [r.novelty for r in df.orderBy("query_id").collect()]


def test_novelty_by_hand(spark):
    corpus = two(spark, [(1, [1.0, 0.0])])
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "query_id long, vec array<double>")
    assert score(novelty.novelty(q, corpus)) == [0.0, 1.0, 1.0]
    assert score(novelty.novelty(q, corpus.where("false"))) == [1.0, 1.0, 1.0]
    assert [novelty.depth(n) for n in (50, 51, 200, 201, 1000, 1001)] == [1, 3, 3, 5, 5, 10] and novelty.depth(9, 4) == 4


def test_novelty_signals(spark):
    c = math.sqrt(1 - 0.64), math.sqrt(1 - 0.16)
    corpus = spark.createDataFrame([(1, [0.8, c[0]], "a"), (2, [0.4, c[1]], "b")], "id long, vec array<double>, cat string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "b", "vague"), (2, [1.0, 0.0], None, "odd"), (3, [1.0, 0.0], "z", "concrete")], "query_id long, vec array<double>, cat string, level string")
    assert score(novelty.novelty(q, corpus, k=2)) == pytest.approx([0.4] * 3)
    assert score(novelty.novelty(q, corpus, k=2, category="cat")) == pytest.approx([0.4 * 0.4 + 0.6 * 0.6, 0.4, 0.4 * 0.4 + 0.6])
    assert score(novelty.novelty(q, corpus, k=2, specificity="level")) == pytest.approx([0.12, 0.4, 0.32])
    m = np.array([[0.8, c[0]], [0.4, c[1]]]).mean(0)
    assert score(novelty.novelty(q, corpus, k=2, centroid=True)) == pytest.approx([0.7 * 0.4 + 0.3 * (1 - m[0] / np.linalg.norm(m))] * 3)
    ages = spark.createDataFrame([(2, math.log(2) / 0.1)], "id long, age double")
    assert score(novelty.novelty(q, corpus, k=2, ages=ages, decay=0.1)) == pytest.approx([1 - (0.8 + 0.2) / 1.5] * 3)
    assert score(novelty.novelty(q, corpus, k=2, ages=ages, decay=0.0)) == pytest.approx([0.4] * 3)


def test_decay_before_ranking(spark):
    p = spark.createDataFrame([(1, 0.9, 100.0), (1, 0.5, 0.0), (1, 0.4, None)], "query_id long, score double, age double")
    assert score(novelty.decayed_before_ranking(p, 2, 0.1)) == pytest.approx([1 - 0.45])


def test_pair_classes(spark):
    rows = [(0.5, "entailment"), (0.6, "entailment"), (0.7, "neutral"), (0.7, "contradiction"), (0.85, "neutral"), (0.9, "contradiction"), (0.9, "entailment")]
    kind, kept = novelty.pair_class(F.col("s"), F.col("e"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "s double, e string").select(kind, kept).collect()]
    assert got == [("NEW", None), ("KNOWN", "entailment"), ("EXTENDS", "neutral"), ("NEW", "contradiction"), ("KNOWN", "neutral"), ("NEW", "contradiction"), ("KNOWN", "entailment")]
    df = spark.createDataFrame([([0.1, 0.5, 0.5],)], "l array<double>")
    assert df.select(novelty.argmax_label(F.col("l"))).first()[0] == "entailment"


def test_recent_against_old(spark):
    day = lambda n: datetime(2024, 1, n)
    items = spark.createDataFrame([(1, "g", day(1), [1.0, 0.0]), (2, "g", day(9), [0.6, 0.8]), (3, "g", day(10), [1.0, 0.0]), (4, "h", day(10), [1.0, 0.0])], "id long, grp string, ts timestamp, vec array<double>")
    got = {r.id: (r.recent, r.old) for r in novelty.recent_against_old(items).collect()}
    assert got == {1: (None, None), 2: (None, 0.6), 3: (0.6, 1.0), 4: (None, None)}


# Whitening, embedding, document similarity


def test_whitening_modes(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 5)) @ rng.standard_normal((5, 5)) + 2
    df = frame(spark, x).repartition(5)
    n, mean, cov = whitening.moments(df)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    for params in ({}, {"epsilon": 0.0}):
        w = whitening.fit(df, **params)
        assert np.allclose(np.cov(((x - w.mean) @ w.w).T, bias=True), np.eye(5), atol=1e-6)
    assert whitening.fit(df, dim=2).dim == 2
    first = np.linalg.eigh(np.cov(x.T))[1][:, -1]
    assert np.allclose(first @ whitening.fit(df, remove=1).w, 0, atol=1e-9)
    got = whitening.fit(df, epsilon=0.1).apply(df.union(spark.createDataFrame([(999, None)], "id long, vec array<double>"))).collect()
    assert [r.vec for r in got if r.id == 999] == [None] and all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in got if r.vec)
    s = whitening.spectrum(df).orderBy("component").collect()
    assert s[-1].cumulative == pytest.approx(1) and s[0].variance >= s[1].variance
    with pytest.raises(ValueError, match="no vectors"):
        whitening.fit(df.where("false"))


def test_embedding_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return embedding.hashing_embedder(8)(texts)

    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "in 2020")], "id long, text string")
    out, cache = embedding.embedded(texts, embed)
    rows = {r.id: r.vec for r in out.collect()}
    assert calls.value == 3 and rows[1] == rows[2] and len(rows[3]) == 8 and cache.count() == 3
    embedding.embedded(texts, embed, cache=cache)[0].collect()
    assert calls.value == 3
    generic, _ = embedding.embedded(texts.union(spark.createDataFrame([(5, "in 2021")], "id long, text string")), embed, genericize=True)
    rows = {r.id: r.vec for r in generic.collect()}
    assert rows[4] == rows[5]
    hits, misses = embedding.cache_split(texts, cache, "hashing")
    assert hits.count() == 4 and misses.count() == 0 and embedding.cache_split(texts, cache, "other")[1].count() == 4
    assert embedding.cache_clear(cache, "hashing").count() == 0 and embedding.cache_model("m", 3) == "m:dim=3"


def test_documents_of_several_fields(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 2.0]), (3, None, [1.0, 0.0])], "id long, vec_s array<double>, vec_c array<double>")
    r = docsim.similar_documents(docs, {"s": 3.0, "c": 1.0}, 0.5).collect()
    assert [(x.a, x.b, x.score, x.field_scores) for x in r] == [(1, 2, round(0.75 / math.hypot(0.75, 0.25), 4), {"s": 1.0, "c": 0.0})]
    assert docsim.similar_documents(docs, {"s": 1.0}, 0.5, most=1).first().field_scores == {}
    with pytest.raises(ValueError):
        docsim.combined({"s": 0.0})
    texts = F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("x"))
    assert spark.range(1).select(docsim.field_text(texts, "a", F.array(F.lit("a"), F.lit("b"))), docsim.field_text(texts, "b", F.array(F.lit("a")))).first()[:] == ("x", "x")
