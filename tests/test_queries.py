"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loamcube.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(x):
    if x is None:
        return ""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def compare(spark, con, fn, sql):
    df = fn(spark, SF)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert sorted(tuple(cell(r[c]) for c in sorted(names)) for r in df.collect()) == want
    return len(want)


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE])
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
