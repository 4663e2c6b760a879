"""Every registered query with SQL against that SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from corpuswatch import plans  # noqa: F401
from corpuswatch.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "None" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, SF)
    data = got.collect()
    if name not in registry.ORACLE_SQL:
        assert data
        return
    want = sql.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, data) == rows(names, want.fetchall())


def test_registry_covers_the_flagship():
    assert "bm25_search" in registry.QUERIES and len(registry.QUERIES) == 76
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)
