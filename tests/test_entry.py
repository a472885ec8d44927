"""Every registered query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from terrapoint.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    rows = df[sorted(df.columns)].astype(object).values.tolist()
    return sorted(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    sql = duckdb.connect()
    for t in TABLES:
        sql.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = sql.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-6)) for p, q in zip(x, y, strict=True)), (x, y)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
