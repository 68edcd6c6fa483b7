"""Per-entity, per-window and global summaries of an event log, and the counts that must reconcile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measures(column: str, digits: int = 6) -> list[Column]:
    """avg, min and max of a measure."""
    return [F.round(F.avg(column), digits).alias(f"avg_{column}"), F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}")]


def category_counts(column: str, domain: Sequence[str]) -> list[Column]:
    """One conditional count per value of a fixed domain; 0 where a value is absent, also on empty input."""
    return [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in domain]


def entity_summary(events: DataFrame, entity: str, time: str, unique: str, category: str, domain: Sequence[str], sensors: Sequence[str], order: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """One row per non-null entity: counts, time range, measures and the ``latest`` columns of its last row by ``order``.

    The last row comes from ``max_by`` in the same aggregation, so one shuffle of partial sums does both.
    """
    last = F.max_by(F.struct(*latest), F.struct(*order))
    return (
        events.where(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(F.count("*").alias("event_count"), F.count_distinct(unique).alias("distinct_events"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), *category_counts(category, domain), *(m for s in sensors for m in measures(s)), last.alias("_last"))
        .select("*", *(F.col(f"_last.{c}").alias(f"latest_{c}") for c in latest))
        .drop("_last")
    )


def entity_windows(events: DataFrame, entity: str, time: str, width: str, category: str, domain: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """Tumbling windows per entity; runs on batch and (with a watermark set) streaming input alike."""
    rows = events.groupBy(entity, F.window(time, width).alias("w")).agg(F.count("*").alias("event_count"), *category_counts(category, domain), *(m for s in sensors for m in measures(s)))
    return rows.select(entity, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in rows.columns if c not in (entity, "w")])


def fleet_summary(events: DataFrame, scope: str, entity: str, unique: str, time: str, category: str, domain: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """Always one row, also on empty input."""
    return events.agg(F.count("*").alias("event_count"), F.count_distinct(unique).alias("distinct_events"), F.count_distinct(entity).alias("entities"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), *category_counts(category, domain), *(m for s in sensors for m in measures(s))).select(F.lit(scope).alias("fleet_scope"), "*")


def zero_filled_counts(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """A row per value of the domain, present or not."""
    names = rows.sparkSession.createDataFrame([(v,) for v in domain], "category string")
    found = rows.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return names.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def mixed_category_entities(rows: DataFrame, entity: str, category: str) -> DataFrame:
    return rows.groupBy(entity).agg(F.count_distinct(category).alias("categories")).where("categories > 1")


def duplicate_grain(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many key values occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicate_groups"))


def reconciliation_gaps(summary: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose parts do not add up to the total, nulls included."""
    added = F.lit(0)
    for p in parts:
        added = added + F.coalesce(F.col(p), F.lit(0))
    return summary.where(~F.col(total).eqNullSafe(added))


def exploded_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def table_digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free sha256 of the rows' text (nulls as empty). Gathers a small table; ``additive_digest`` is for large ones."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.select(line.alias("line")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("digest"), F.count("*").alias("n"))


def additive_digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free digest in constant memory per task: counts and two folds of row hashes."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_000_007))), F.lit(0)).alias("sum"))


def feature_statistics(rows: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Population statistics per column, long form, from one pass."""
    one = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))))
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), *(F.round(F.col(f"{n}_{c}").cast("double"), digits).alias(n) for n in ("min", "max", "mean", "std"))) for c in columns))
    return one.select(F.inline(parts))
