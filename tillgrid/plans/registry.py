"""Assembles the query registry from the catalogue modules."""

from __future__ import annotations


def _load():
    from tillgrid.plans import catalog  # noqa: F401  (registers S, P, J, A, N, K, U, F)
    from tillgrid.plans import catalog_rules  # noqa: F401  (registers W and presence)
    from tillgrid.plans import catalog_streams  # noqa: F401  (registers ST1-ST5)
    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracle_sql():
    return dict(_load().ORACLE)
