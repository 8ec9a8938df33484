import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import clusters
from curatrix.streaming import jobs


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 05:00:00", "a", 1.0), (2, "2024-01-01 07:00:00", "", 2.0), (1, "2024-01-02 01:00:00", "a", 4.0), (3, "2024-01-09 01:00:00", "b", 8.0)], "item long, t string, tier string, cost double")
    rows = rows.select("item", F.to_timestamp("t").alias("ts"), "tier", "cost").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    return jobs.table_stream(spark, str(tmp_path / "in"), rows.schema)


def test_daily_summary(events):
    got = {(str(r.day)[:10], r.tier): (r.entries, r.cost) for r in drained(jobs.daily_summary(events), "daily", "complete").collect()}
    assert got == {("2024-01-01", "a"): (1, 1.0), ("2024-01-01", "unknown"): (1, 2.0), ("2024-01-02", "a"): (1, 4.0), ("2024-01-09", "b"): (1, 8.0)}


def test_keys(events):
    assert {r.item: r.latest for r in drained(jobs.latest_per_key(events, "item", "ts", "cost"), "latest", "complete").collect()} == {1: 4.0, 2: 2.0, 3: 8.0}
    assert drained(jobs.first_per_key(events, "item", "ts", "30 days"), "firsts").count() == 3


def test_append_and_audit_stream(spark, events, tmp_path):
    q = jobs.append_by_day(events, str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(p.name for p in (tmp_path / "log").glob("dt=*")) == ["dt=20240101", "dt=20240102", "dt=20240109"]
    (tmp_path / "audit").mkdir()
    (tmp_path / "audit" / "x.json").write_text(json.dumps({"ts": "2024", "item_id": "a", "action": "fix"}) + "\nbroken\n")
    assert drained(jobs.audit_stream(spark, str(tmp_path / "audit")), "audit").count() == 1


def test_stream_clusters_as_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3))
    df = spark.createDataFrame([("k", i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "key string, id long, vec array<double>")
    for i, (low, high) in enumerate(((0, 20), (20, 45), (45, 60))):
        df.where((F.col("id") >= low) & (F.col("id") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in" / "*"))
    got = {r.id: r.cluster for r in drained(jobs.clustered(stream, 0.9), "clusters").collect()}
    assert got == {r.id: r.cluster for r in clusters.incremental_clusters(df, 0.9, key="key").collect()}


def test_each_batch_once(spark, events, tmp_path):
    seen = []
    for _ in range(2):
        jobs.each_batch(events, lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 4


def test_stream_against_a_snapshot(spark, tmp_path):
    q = spark.createDataFrame([(1, "k", [1.0, 0.0])], "query_id long, key string, vec array<double>")
    q.write.parquet(str(tmp_path / "in"))
    snap = spark.createDataFrame([("k", 7, [0.5, 0.5], 10.0), ("k", 8, [1.0, 0.0], None)], "key string, id long, vec array<double>, age double")
    got = drained(jobs.scored_against(jobs.table_stream(spark, str(tmp_path / "in"), q.schema), snap, 1, 0.1), "scored")
    assert {r.id: round(r.score, 6) for r in got.collect()} == {7: round(0.5 * np.exp(-1), 6), 8: 1.0}
