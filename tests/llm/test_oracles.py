"""The operators' queries against their SQL, over whole tables."""

import duckdb
import pytest

from inkwell.llm.oracles import SQL
from inkwell.llm.queries import QUERIES

from ..test_catalogue import rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, rel = QUERIES[name](spark, data), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    mine, theirs = rows_of(got.columns, got.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(mine) == len(theirs)
    assert [p for p in zip(mine, theirs) if p[0] != p[1]][:3] == []
