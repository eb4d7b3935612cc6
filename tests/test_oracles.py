"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tallyglass import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    got = con.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in order] for r in got.fetchall()), key=str)
    have = sorted(([plain(r[c]) for c in order] for r in frame.collect()), key=str)
    assert have == want


def test_queries_without_sql(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, SF).columns
