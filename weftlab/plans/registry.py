"""All registered queries of the library's own operators."""

from __future__ import annotations

from weftlab.plans import bicluster_queries, evaluate_queries, prepare_queries

MODULES = [prepare_queries, bicluster_queries, evaluate_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
