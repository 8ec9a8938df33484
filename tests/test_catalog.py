"""Every catalogue query with SQL gives what DuckDB gives; the others are tested against brute force elsewhere."""

import math

import duckdb
import pytest

import __spark_entry__
from curatrix.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_as_sql(name, spark, small, duck):
    df = catalog.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = [tuple(map(plain, r)) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"] and df.count() > 0


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
