"""Helpers for operators that stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of digits, a-z and non-ASCII characters, as Java's regex reads it.
ALNUM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Rows of a two-column look-up table that may be broadcast: under 100 MB in an executor.
BROADCAST_ROWS = 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, even if the body's lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def fold_ascii(text: Column) -> Column:
    """Lower case for A-Z alone; a null is an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def alnum_words(text: Column) -> Column:
    return F.regexp_extract_all(fold_ascii(text), F.lit(ALNUM_WORD), F.lit(0))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the limit, else as it is."""
    return F.broadcast(df) if rows <= limit else df
