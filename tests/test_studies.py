import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import knowledge, studies, whitening


def test_evaluation_pairs(spark):
    rows = [(i, i // 4 if i < 40 else None, f"s{i % 3}") for i in range(60)]
    items = spark.createDataFrame(rows, "id long, grp long, source string")
    got = studies.evaluation_pairs(items, 15).collect()
    grp, source = {i: g for i, g, _ in rows}, {i: s for i, _, s in rows}
    kinds = {k: [(r.a, r.b) for r in got if r.kind == k] for k in ("group", "source", "random")}
    assert all(len(set(p)) == len(p) == 15 for p in (kinds["group"], kinds["source"]))
    assert all(grp[a] == grp[b] is not None and a < b for a, b in kinds["group"])
    assert all(source[a] == source[b] for a, b in kinds["source"]) and all(source[a] != source[b] for a, b in kinds["random"])
    assert {tuple(r) for r in studies.evaluation_pairs(items.repartition(5), 15).collect()} == {tuple(r) for r in got}


def test_cross_lingual_and_noise(spark):
    x = np.random.default_rng(0).standard_normal((40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    r = studies.cross_lingual(df, df).first()
    assert (r.n, r.mrr, r.recall_1) == (40, 1.0, 1.0)
    some = studies.noisy(df, 0.05)
    assert {r.id: r.vec for r in some.collect()} == {r.id: r.vec for r in studies.noisy(df.repartition(3), 0.05).collect()}
    r = studies.cross_lingual(some, df.where("id < 30")).first()
    assert r.mrr == pytest.approx(0.75)
    assert studies.noisy(df.where("false"), 1.0).count() == 0


def test_slices_and_samples(spark):
    pairs = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(1, 9)], "score double, label string")
    got = {(r.quartile, r.label): r.n for r in studies.label_slices(pairs).collect()}
    assert got == {(q, label): 1 for q in range(1, 5) for label in "ab"}
    both = spark.createDataFrame([(0.9, 0.1), (0.1, 0.9), (0.9, 0.9), (0.1, 0.1), (0.8, 0.2)], "cosine double, novelty double")
    assert {r["class"]: r.n for r in studies.alignment(both, 0.5, 0.5).collect()} == {"both_known": 2, "both_new": 1, "near_but_new": 1, "far_but_known": 1}
    ids = spark.range(20)
    assert sorted(r.id for r in studies.every_nth(ids, [F.col("id")], 6).collect()) == [0, 6, 12, 18]
    assert studies.balanced(ids.withColumn("y", F.col("id") % 3), "y", 4).groupBy("y").count().where("count <> 4").count() == 0


def test_components_of_variance(spark):
    x = np.random.default_rng(1).standard_normal((200, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    w = whitening.subspace(df, 1, 3)
    assert w.dim == 2 and np.allclose(w.w.T @ w.w, np.eye(2)) and abs(w.w[0]).max() < 0.2
    got = {r.side: r.projection for r in whitening.extremes(df, 0, 1).collect()}
    assert got["high"] > 8 > -8 > got["low"]


def test_network_sweep(spark):
    g = knowledge.Graph(knowledge.chain(3))
    answers = spark.createDataFrame([(1, 1, "n1", "deep"), (2, 1, "n0", "none")], "session_id long, seq long, node string, familiarity string")
    truth = spark.createDataFrame([(1, "n0", True), (1, "n2", True), (2, "n1", False), (2, "n2", False)], "session_id long, node string, known boolean")
    got = knowledge.network_sweep(g, answers, truth, [knowledge.Network(0.9), knowledge.Network(0.1, 0.05)]).collect()
    assert [(r.ready, r.accuracy) for r in got] == [(0.9, 1.0), (0.1, 0.75)]
