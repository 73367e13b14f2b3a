"""Helpers shared by the registered query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (results are compared at 6 digits)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def bigint_counts(sql: str) -> str:
    """Rewrite ``count_if(x)`` as ``count(*) FILTER (WHERE x)`` in oracle SQL:
    DuckDB types ``count_if`` as HUGEINT, Spark's counts are BIGINT."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(f"count(*) FILTER (WHERE {bigint_counts(sql[j + len(key):k - 1])})")
        i = k


class Registry:
    """Collects ``name -> (query fn, oracle sql | None)`` for one plan module."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = bigint_counts(sql)
            return fn
        return deco
