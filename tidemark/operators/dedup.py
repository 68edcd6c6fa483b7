"""Canonical rows, the audit of their duplicates, and the accounts that both must keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], attach: Sequence[str] = ()) -> DataFrame:
    """``duplicate_rank`` (1 = canonical) and the canonical row's ``attach`` columns, from one window over one shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select("*", F.row_number().over(w).alias("duplicate_rank"), *(F.first(c).over(w).alias(f"canonical_{c}") for c in attach))


def canonical(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return ranked(rows, keys, order).where("duplicate_rank = 1").drop("duplicate_rank")


def audit(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], attach: Sequence[str]) -> DataFrame:
    return ranked(rows, keys, order, attach).where("duplicate_rank > 1")


def accounting(rows: DataFrame, keys: Sequence[str], rejected: Column) -> DataFrame:
    """One row: read = quarantined + valid, valid = canonical + duplicates."""
    counts = rows.agg(F.count("*").alias("bronze_rows"), F.count_if(rejected).alias("quarantined_rows"), F.count_if(~rejected).alias("valid_rows"))
    groups = rows.where(~rejected).groupBy(*keys).count().agg(F.count("*").alias("canonical_rows"))
    both = counts.join(groups)
    both = both.withColumn("duplicate_rows", F.col("valid_rows") - F.col("canonical_rows"))
    return both.withColumn("holds", (F.col("bronze_rows") == F.col("quarantined_rows") + F.col("valid_rows")) & (F.col("duplicate_rows") >= 0))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (a tuple comparison), without a sort."""
    got = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return got.select("r.*")


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).join(b.select(*keys), list(keys)).agg(F.count("*").alias("overlapping"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def key_alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    l, r = a.select(F.col(key).alias("k"), F.lit(1).alias("l")).distinct(), b.select(F.col(key).alias("k"), F.lit(1).alias("r")).distinct()
    both = l.join(r, "k", "full_outer")
    return both.where("l IS NULL OR r IS NULL").select(F.col("k").alias(key), F.when(F.col("l").isNull(), F.lit("unexpected")).otherwise(F.lit("missing")).alias("side"))
