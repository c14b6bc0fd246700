"""Every registered query runs; every one with SQL equals DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from skarn.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    rel = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    first = registry.QUERIES[name](spark, sf)
    assert first.columns
    first.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_llm_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "skarn")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert "skarn.llm" not in open(os.path.join(folder, n)).read(), n
