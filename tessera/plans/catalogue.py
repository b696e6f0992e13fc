"""All queries of the library outside the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import backtests, panels, signals, studies, wavelets

SECTIONS = [panels, signals, wavelets, backtests, studies]


def queries() -> dict[str, Callable]:
    return {name: f for s in SECTIONS for name, f in s.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for s in SECTIONS for name, sql in s.query.sql.items()}
