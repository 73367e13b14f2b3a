"""Every registered query against its DuckDB oracle (row count, columns, values)."""

import math

import duckdb
import pandas as pd
import pytest

from conftest import SF_SMALL

from evalframe.plans import oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES = queries()
ORACLE = oracle_sql()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


# queries that SQL cannot express, and the tests that hold them against brute force
NO_SQL = {"rouge_lsum"}  # test_matching.py


def test_every_query_has_an_oracle():
    assert set(QUERIES) - NO_SQL == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in ORACLE:
        assert len(sdf.columns) > 0
        return
    sc, sr = _rows(sdf)
    dc, dr = _rows(con.execute(ORACLE[name]).df())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert set(df.columns) >= {"user_id", "run_id", "mean_combined_score", "std_combined_score"}
    assert df.count() > 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_column_types_match_oracle(spark, con, name):
    st = {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, SF_SMALL).schema.fields}
    rel = con.sql(ORACLE[name])
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in st.items()} == dt
