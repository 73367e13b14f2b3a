"""The queries of this part that SQL can express, against DuckDB."""

import duckdb
import pytest

from evalframe.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = con.execute(oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, sql.fetchall()))
