"""Read queries over materialised tables: pages, details, listings, look-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFound(LookupError):
    """An entity that a query names does not exist."""


def require(rows: DataFrame, column: str, value: object) -> None:
    if rows.where(F.col(column) == value).isEmpty():
        raise NotFound(f"{column} = {value!r}")


def filtered(rows: DataFrame, equal: Mapping[str, object | None], more: Sequence[Column] = ()) -> DataFrame:
    """AND of the filters that are given; an absent (None) filter is no predicate."""
    conditions = [F.col(c).eqNullSafe(v) if isinstance(v, bool) else F.col(c) == v for c, v in equal.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, [*conditions, *more])) if conditions or more else rows


def page(rows: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def detail_counts(entities: DataFrame, key: str, counted: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Entities with the number of their rows in each counted table (0 if none): one partial aggregation and join each."""
    for name, (rows, foreign) in counted.items():
        n = rows.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        entities = entities.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return entities


def ordered_lists(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, its rows as an ordered array of structs."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("items"))


def nested_when(present: Column, **columns: Column) -> Column:
    """A struct, or null where ``present`` is null."""
    return F.when(present.isNotNull(), F.struct(*(c.alias(n) for n, c in columns.items())))
