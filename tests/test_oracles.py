"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


SQL = entry.engine.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got = entry.engine.QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert sorted(rel.columns) == cols
    value = lambda x: round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(value(r[i]) for i in at) for r in rel.fetchall())
    assert Counter(tuple(value(r[c]) for c in cols) for r in got.collect()) == want
