import pytest
from pyspark.sql import functions as F

from curatrix.operators import knowledge as K

CHAIN = [{"id": "a", "title": "A", "obscurity": 1}, {"id": "b", "title": "B", "obscurity": 2, "prerequisites": ["a"]}, {"id": "c", "title": "C", "obscurity": 3, "prerequisites": ["b"]}]
DIAMOND = [{"id": "top"}, {"id": "l", "prerequisites": ["top"]}, {"id": "r", "prerequisites": ["top"]}, {"id": "end", "prerequisites": ["l", "r"]}]


def test_graph_checks():
    with pytest.raises(ValueError, match="repeat"):
        K.Graph([{"id": "a"}, {"id": "a"}])
    with pytest.raises(ValueError, match="cycle"):
        K.Graph([{"id": "a", "prerequisites": ["b"]}, {"id": "b", "prerequisites": ["a"]}])
    g = K.Graph([{"id": "a", "prerequisites": ["ghost"]}])
    assert g.order() == ["ghost", "a"] and g.prior("ghost") == pytest.approx(0.26)
    fixed = K.without_cycles([{"id": "a", "prerequisites": ["b", "a", "x"]}, {"id": "b", "prerequisites": ["a"]}])
    assert K.Graph(fixed) and all(n["level"] == 2 and n["obscurity"] == 3 for n in fixed)
    assert K.Graph(DIAMOND).order() == ["top", "l", "r", "end"]


def test_priors():
    assert K.start(K.Graph(CHAIN)).p == pytest.approx({"a": 0.42, "b": 0.34, "c": 0.26})
    assert K.start(K.Graph([{"id": "x", "obscurity": 9}])).p == {"x": 0.05}
    assert K.start(K.Graph(CHAIN), prior=lambda n: 0.5).p == {"a": 0.5, "b": 0.5, "c": 0.5}


def test_bayesian_chain_by_hand():
    g = K.Graph(CHAIN)
    b = K.answer(g, K.start(g, bayesian=True), "b", "solid")
    # a: likelihood of b known is .9 if a is known, .05 if not; c: .9 below a known b.
    assert b.p["a"] == pytest.approx(0.42 * 0.9 / (0.42 * 0.9 + 0.58 * 0.05))
    assert b.p["c"] == pytest.approx(0.9) and b.p["b"] == 0.85
    b = K.answer(g, K.start(g, bayesian=True), "a", "none")
    assert b.p["b"] == pytest.approx(0.05) and b.p["c"] == pytest.approx(0.9 * 0.05 + 0.05 * 0.95)
    untouched = K.start(g, bayesian=True)
    K.spread(g, untouched, None, None)
    assert untouched.p == K.start(g).p


def test_heuristic_by_hand():
    g = K.Graph(CHAIN)
    h = K.Heuristic(sweeps=0)
    b = K.answer(g, K.start(g), "a", "none", h=h)
    assert b.p == pytest.approx({"a": 0.05, "b": 0.08, "c": 0.064})
    b = K.answer(g, K.start(g), "c", "basic", h=h)
    assert b.p == pytest.approx({"a": 1 - 0.35 * 0.64, "b": 1 - 0.35 * 0.8, "c": 0.7})
    b = K.answer(g, K.start(g), "c", "deep", h=h)
    assert b.p["b"] == pytest.approx(1 - 0.2 * 0.8)
    b = K.answer(g, K.start(g), "a", "solid")
    assert b.p["b"] == pytest.approx(0.5 + 0.35 * 0.35 / 0.5)
    with pytest.raises(ValueError):
        K.answer(g, K.start(g), "a", "expert")


def test_noisy_update():
    g = K.Graph([{"id": "a"}])
    b = K.Beliefs({"a": 0.4})
    assert K.answer(g, b, "a", "solid", noisy=True).p["a"] == pytest.approx(0.4 * 0.95 / (0.4 * 0.95 + 0.6 * 0.15))
    b = K.Beliefs({"a": 0.4})
    assert K.answer(g, b, "a", "none", noisy=True).p["a"] == pytest.approx(0.4 * 0.05 / (0.4 * 0.05 + 0.6 * 0.85))
    assert b.history[0]["before"] == 0.4 and b.assessed == {"a"}


def test_probes():
    g = K.Graph(DIAMOND)
    b = K.start(g)
    before = dict(b.p)
    assert K.next_probe(g, b)["node"] in g.nodes and b.p == before and not b.assessed
    assert K.next_probe(g, b, "entropy")["node"] == "top"
    batch = K.probe_batch(g, b, 3)
    assert len({x["node"] for x in batch}) == len(batch) and b.p == before
    done = K.Beliefs(dict(b.p), set(g.nodes))
    assert K.next_probe(g, done) is None and K.probe_batch(g, done, 2) == []
    assert [K.question_type(*x) for x in ((0, 5, 0.9), (4, 2, 0.9), (4, 1, 0.9), (5, 3, 0.5))] == ["recognition", "comparison", "scoping", "recognition"]


def test_calibration():
    assert K.false_alarm_factor([]) == 1.0 and K.false_alarm_factor(["none", "basic", "deep", "heard_of"]) == 0.5
    b = K.discounted(None, K.Beliefs({"a": 0.9, "b": 0.4}), 0.5)
    assert b.p == pytest.approx({"a": 0.7, "b": 0.4})
    assert K.total_entropy(K.Beliefs({"a": 0.5, "b": 1.0, "c": 0.0})) == 1.0


def test_sessions_in_parallel(spark):
    g = K.Graph(CHAIN)
    answers = spark.createDataFrame([(1, 2, "a", "none"), (1, 1, "c", "deep"), (2, 1, "b", "solid")], "session_id long, seq long, node string, familiarity string")
    for bayesian in (True, False):
        got = {(r.session_id, r.node): r.p for r in K.simulated(g, answers, bayesian).collect()}
        for s, steps in ((1, [("c", "deep"), ("a", "none")]), (2, [("b", "solid")])):
            b = K.start(g, bayesian=bayesian)
            for node, f in steps:
                K.answer(g, b, node, f)
            assert {n: p for (x, n), p in got.items() if x == s} == pytest.approx(b.p)


def test_trials(spark):
    trials = spark.createDataFrame([(i, s) for i in range(8) for s in ("eig", "random")], "trial long, strategy string")
    rows = K.probing_trials(K.Graph(K.tree(7)), trials, 7).collect()
    assert {r.accuracy for r in rows if r.asked == 7} == {1.0} and len(rows) == 16 * 7
    for make in (K.chain, K.tree, K.flat, K.dense):
        assert len(K.Graph(make(9)).order()) == 9


def test_tables(spark):
    nodes = K.node_table(spark, K.Graph(DIAMOND))
    b = spark.createDataFrame([(1, "top", 0.9, True), (1, "l", 0.8, False), (1, "r", 0.1, False), (1, "end", 0.5, False)], "session_id long, node string, p double, assessed boolean")
    r = K.coverage(b, nodes).first()
    assert (r.level, r.known, r.unknown, r.uncertain, r.total, r.percent_known) == (2, 2, 1, 1, 4, 50.0)
    r = K.coverage_lists(b).first()
    assert (r.known, r.unknown, r.uncertain) == (["top", "l"], ["r"], ["end"])
    r = K.converged(b).first()
    assert (r.open, r.converged, round(r.entropy, 4)) == (1, True, 2.6599)
    assert sorted((x.node, x.fringe) for x in K.fringes(b, K.links(nodes)).collect()) == [("l", "inner"), ("r", "outer"), ("top", "inner")]
    assert [x.node for x in K.open_nodes(b).orderBy("node").collect()] == ["end", "l", "r"]
    assert nodes.select(K.prior(F.col("obscurity"))).first()[0] == pytest.approx(0.26)
    long = nodes.withColumn("description", F.when(F.col("node") == "l", "One. Two. Three").when(F.col("node") == "r", "short")).withColumn("obscurity", F.lit(5))
    got = sorted(tuple(x) for x in K.graph_problems(long).collect())
    assert got == [("end", "no description"), ("l", "several ideas"), ("r", "no description"), ("top", "no description"), ("top", "obscure without prerequisites")]
