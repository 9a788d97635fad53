"""Queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from . import corpus, oracles, structure


def queries() -> dict:
    return {name: getattr(corpus, name) for name in oracles.SQL} | {name: getattr(structure, name) for name in structure.SQL}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | structure.SQL
