"""Query catalogue: every registered operator plan plus its DuckDB oracle."""

from __future__ import annotations

import importlib

# plan modules, in catalogue order
MODULES = ["scoring", "cleaning", "analysis", "stats", "runs", "quality", "masking", "prompts", "patterns"]


def _load():
    queries, oracle = {}, {}
    for m in MODULES:
        reg = importlib.import_module(f"evalframe.plans.{m}").reg
        for k in reg.queries:
            if k in queries:
                raise ValueError(f"duplicate query {k}")
        queries.update(reg.queries)
        oracle.update(reg.oracle)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
