"""Queries of the text operators by name, with SQL where it can express them."""

from __future__ import annotations

from loomfield.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict:
    return dict(q.ORACLE)
