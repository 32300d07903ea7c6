"""Registered queries."""

from __future__ import annotations


def _load():
    from tidemark.plans import basic, engagement, graphs, learning, measures, ranking, registry  # noqa: F401

    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict:
    return dict(_load().ORACLE)
