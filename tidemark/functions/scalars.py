"""Scalar expressions that several layers share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it (the optimizer would repeat it)."""
    return F.transform(F.array(value), body)[0]


def differs(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def is_true(condition: Column) -> Column:
    """A condition whose null counts as false."""
    return F.coalesce(condition, F.lit(False))


def clamp(x: Column, least: float, most: float) -> Column:
    """``x`` held to the bounds; a null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), x)))


def utc_milliseconds(ts: Column) -> Column:
    """A timestamp as text with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based (version 5) UUID text: sha1 of the namespace bytes and the name, with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


#: Fixed value: the namespace of URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def canonical_sha256(columns: Sequence[str]) -> Column:
    """sha256 of the named columns as compact JSON in that order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def tuple_newer(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """(a...) > (b...) by the first difference."""
    return F.struct(*a) > F.struct(*b)
