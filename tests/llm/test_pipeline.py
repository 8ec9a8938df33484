"""The pipeline's stages, each on what its predecessor kept, against plain Python."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from curatrix.llm import mixing, quality, queries, toxicity
from tests.llm.test_exact import brute_links, brute_tokens, joined, shares


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, small).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def pandas(df):
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


def test_columns_stay(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
    assert stages[-1][2].count() > 0


def test_toxicity_stage(spark, small, stages):
    _, before, after = stages[0]
    _, _, linear = toxicity.train(before, spark.read.parquet(f"{small}/labels.parquet"))
    b = pandas(before)
    score = linear.score(b.text.tolist(), toxicity.Weights(linear.w))
    assert pandas(after).doc_id.tolist() == b.doc_id[score < 0.4].tolist()


def test_quality_stage(spark, small, stages):
    _, before, after = stages[1]
    trees = quality.train(before, spark.read.parquet(f"{small}/labels.parquet"))
    b = pandas(before)
    assert pandas(after).doc_id.tolist() == b.doc_id[trees.predict(quality.matrix(b.text.tolist())) >= 0.5].tolist()


def test_dedup_stage(stages):
    _, before, after = stages[2]
    sizes, near, holders = brute_links([(r.doc_id, r.text) for r in before.collect()])
    groups = joined(near + [(a, b) for a, bs in holders.items() for b in bs])
    kept = set(pandas(after).doc_id)
    assert {r.doc_id for r in before.collect()} - set(groups) <= kept
    members = defaultdict(list)
    for i, g in joined(near).items():
        members[g].append(i)
    one = sum(sum(i in kept for i in m) <= 1 for m in members.values())
    assert one >= 0.95 * len(members) and all(any(i in kept for i in m) for m in members.values() if not any(i in holders for i in m))


def test_mixing_stage(stages):
    _, before, after = stages[3]
    b, a = pandas(before), pandas(after)
    n = b.doc_id.map(brute_tokens(before))
    words = {s: float(x) for s, x in n.groupby(b.source).sum().items()}
    p = shares(words, {s: w**mixing.TEMPERATURE for s, w in words.items()}, mixing.SHARE)
    for s in words:
        assert abs((a.source == s).sum() - p[s] * (b.source == s).sum()) < 2
    assert set(a.doc_id) <= set(b.doc_id)


def test_packing_stage(stages):
    _, before, after = stages[4]
    got = after.toPandas()
    want = {i: n for i, n in brute_tokens(before).items() if n}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert got.groupby("bin_id").n_tokens.sum().max() <= 2048


def test_run_gives_the_last_stage(spark, small, stages):
    key = ["doc_id", "piece", "n_tokens"]
    got = corpus_pipeline.run(spark, small).toPandas()[key].sort_values(key).to_numpy()
    assert np.array_equal(got, stages[-1][2].toPandas()[key].sort_values(key).to_numpy())


def test_every_query_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
