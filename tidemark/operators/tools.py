"""Bounded read-only tools: each has a name, allowed arguments and one query over given tables; nothing else can be asked."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import serving

MAX_ROWS = 50
SNAPSHOT_ROWS = 3


class ToolError(ValueError):
    """An unknown tool, an argument it does not take, or a value out of bounds."""


def limit(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= MAX_ROWS:
        raise ToolError(f"limit must be an integer from 1 to {MAX_ROWS}")
    return value


def one_of(*allowed: str) -> Callable[[Any], str]:
    def check(value: Any) -> str:
        if value not in allowed:
            raise ToolError(f"{value!r} is not one of {', '.join(allowed)}")
        return value

    return check


def flag(value: Any) -> bool:
    if not isinstance(value, bool):
        raise ToolError("a flag must be true or false")
    return value


def whole(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ToolError("an id must be an integer")
    return value


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    takes: Mapping[str, Callable[[Any], Any]]
    needs: tuple[str, ...] = ()


def call(tools: Mapping[str, Tool], name: str, tables: Mapping[str, DataFrame], arguments: Mapping[str, Any]) -> DataFrame:
    """The rows of a tool; every argument is checked before any table is read."""
    if name not in tools:
        raise ToolError(f"unknown tool: {name}")
    tool = tools[name]
    for a in arguments:
        if a not in tool.takes:
            raise ToolError(f"unexpected argument for {name}: {a}")
    for a in tool.needs:
        if a not in arguments:
            raise ToolError(f"{name} needs {a}")
    return tool.run(tables, **{a: tool.takes[a](v) for a, v in arguments.items() if v is not None})


def listing(table: str, columns: tuple[str, ...], order: tuple, equal: tuple[str, ...], most: int = 10) -> Callable[..., DataFrame]:
    """A tool that lists a table's columns in order, filtered by the arguments that are given."""

    def run(tables: Mapping[str, DataFrame], limit: int = most, **given: Any) -> DataFrame:
        rows = serving.filtered(tables[table], {c: given.get(c) for c in equal})
        return serving.page(rows.select(*columns), order, limit, most=MAX_ROWS)

    return run


def detail(table: str, key: str, columns: tuple[str, ...]) -> Callable[..., DataFrame]:
    """A tool that reads one entity, or raises NotFound."""

    def run(tables: Mapping[str, DataFrame], **given: Any) -> DataFrame:
        serving.require(tables[table], key, given[key])
        return tables[table].where(F.col(key) == given[key]).select(*columns)

    return run


def snapshot(entity: str, key: str, columns: tuple[str, ...], lists: Mapping[str, tuple[str, str, tuple[str, ...], tuple, Any, int]]) -> Callable[..., DataFrame]:
    """One entity with short ordered lists of its newest rows in other tables: name to (table, foreign key, columns, order, condition, rows).

    Each list is cut by top-k before it becomes an array.
    """

    def run(tables: Mapping[str, DataFrame], **given: Any) -> DataFrame:
        out = detail(entity, key, columns)(tables, **given)
        for name, (table, foreign, kept, order, condition, n) in lists.items():
            rows = tables[table].where(F.col(foreign) == given[key])
            top = (rows if condition is None else rows.where(condition)).orderBy(*order).limit(n).select(*kept)
            out = out.join(top.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*kept)))).alias(name)))
        return out

    return run
