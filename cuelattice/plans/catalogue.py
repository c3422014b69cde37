"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, dialogue, hearing, proofs, scores, solvers, soundings, timeline

_MODULES = (timeline, dialogue, scores, solvers, proofs, hearing, answers, soundings)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
