"""Every registered query of the engine with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import analysis, audits, ingestion, reports, scoring, serving

_PARTS = (ingestion, serving, analysis, reports, audits, scoring)


def _merged(parts: list[dict]) -> dict:
    """One dict of all; a name that two modules use is an error, as one query would hide the other."""
    found: dict = {}
    for part in parts:
        if twice := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= part
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged([part.QUERIES for part in _PARTS])


def oracle_sql() -> dict[str, str]:
    return _merged([part.SQL for part in _PARTS])
