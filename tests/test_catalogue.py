"""Every query with SQL gives the same rows in both engines."""

import math
import os

import pytest

from inkwell.plans import catalogue

TABLES = ["documents", "labels", "benchmark", "pages", "conversations", "embeddings", "events"]
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    mine, theirs = rows_of(got.columns, got.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(mine) == len(theirs)
    assert [p for p in zip(mine, theirs) if p[0] != p[1]][:3] == []
    assert mine, "an empty result shows nothing"


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
