"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from simlattice.plans import pair_queries, run_queries, text_queries

_PARTS = (text_queries, pair_queries, run_queries)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
