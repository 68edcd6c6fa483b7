"""Whole reports on the finished layers: one row each, every figure from as few passes as its table allows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import overlap
from tidemark.operators.ordered import null_safe_join


def _counts_text(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row: ``value=count`` of every value, in the values' order, as text; an empty text for no rows."""
    got = rows.groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return got.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("v", "n"))), lambda x: F.concat_ws("=", F.coalesce(x["v"], F.lit("null")), x["n"].cast("string")))).alias(name))


def _beside(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of one row each, side by side."""
    return reduce(lambda a, b: a.join(b), parts)


def canonical_report(raw: DataFrame, canonical: DataFrame, duplicates: DataFrame, quarantined: DataFrame, unique: str, entity: str, time: str, kind: str, coordinates: Sequence[str], reason: str) -> DataFrame:
    """One row about a deduplicated layer: sizes and their accounts, ids, times, entities, kinds, reasons, overlaps, nulls and field types.

    ``duplicates`` has duplicate_rank; ``quarantined`` an array column ``reason``; nothing in any table gives zeros and empty texts.
    """
    types = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in canonical.schema)
    body = canonical.agg(
        F.count("*").alias("canonical_rows"),
        F.count_distinct(unique).alias("distinct_ids"),
        F.count_if(F.col(unique).isNull()).alias("null_ids"),
        F.count_if(F.col(entity).isNull()).alias("null_entities"),
        F.count_distinct(entity).alias("entities"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in coordinates),
    )
    # each coordinate once on either side, so that a frequent one gives no pairs
    places = quarantined.select(*coordinates).distinct()
    shared = lambda rows: overlap(places, rows.select(*coordinates).distinct(), coordinates)
    repeated = canonical.groupBy(unique).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    audit = duplicates.agg(F.count("*").alias("duplicate_rows"), F.coalesce(F.max("duplicate_rank"), F.lit(0)).cast("bigint").alias("max_duplicate_rank"))
    one = _beside([
        raw.agg(F.count("*").alias("raw_rows")),
        body,
        repeated,
        audit,
        quarantined.agg(F.count("*").alias("quarantined_rows")),
        _counts_text(canonical, kind, "kind_counts"),
        _counts_text(quarantined.select(F.explode(reason).alias("r")), "r", "reason_counts"),
        shared(canonical).withColumnRenamed("overlapping", "quarantined_and_canonical"),
        shared(duplicates).withColumnRenamed("overlapping", "quarantined_and_duplicate"),
    ])
    valid = F.col("canonical_rows") + F.col("duplicate_rows")
    holds = (F.col("raw_rows") == valid + F.col("quarantined_rows")) & (F.col("repeated_ids") == 0)
    return one.withColumn("valid_rows", valid).withColumn("holds", holds).withColumn("field_types", F.lit(types))


def summary_report(source: DataFrame, entities: DataFrame, windows: DataFrame, fleet: DataFrame, entity: str, time: str, kind: str, kinds: Sequence[str], latest: str, order: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """One row about the three summaries of a layer against the rows they were made from."""
    total = sum((F.col(f"n_{k}") for k in kinds), F.lit(0))
    numbers = lambda rows: [c for c, t in rows.dtypes if t in ("double", "float")]
    odd = lambda rows: F.count_if(reduce(lambda a, b: a | b, [F.coalesce(F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf"))), F.lit(False)) for c in map(F.col, numbers(rows))], F.lit(False)))
    truth = source.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("_n"), F.max_by(latest, F.struct(*order)).alias("_latest"), F.count_distinct(kind).alias("_kinds"))
    compared = null_safe_join(entities.select(entity, "event_count", f"latest_{latest}"), truth, [entity])
    grain = lambda rows, keys, name: rows.groupBy(*keys).agg(F.count("*").alias("_c")).agg(F.count_if(F.col("_c") > 1).alias(name))
    named = [*entities.columns, *windows.columns, *fleet.columns]
    parts = [
        source.agg(F.count("*").alias("source_rows"), F.count_distinct(entity).alias("source_entities"), F.min(time).alias("first_time"), F.max(time).alias("last_time")),
        entities.agg(F.count("*").alias("entity_rows"), F.count_distinct(entity).alias("distinct_entities"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("entity_events"), F.count_if(total != F.col("event_count")).alias("entity_kind_mismatches"), odd(entities).alias("odd_entity_numbers")),
        windows.agg(F.count("*").alias("window_rows"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("window_events"), F.count_if(total != F.col("event_count")).alias("window_kind_mismatches"), odd(windows).alias("odd_window_numbers")),
        fleet.agg(F.count("*").alias("fleet_rows"), F.max("event_count").alias("fleet_events"), F.max("entities").alias("fleet_entities"), F.max(total).alias("fleet_kind_sum"), odd(fleet).alias("odd_fleet_numbers")),
        compared.agg(F.count_if(F.col("event_count") != F.col("_n")).alias("entity_count_mismatches"), F.count_if(~F.col(f"latest_{latest}").eqNullSafe(F.col("_latest"))).alias("latest_mismatches"), F.count_if(F.col("_kinds") > 1).alias("entities_of_several_kinds")),
        grain(entities, [entity], "repeated_entities"),
        grain(windows, [entity, "window_start", "window_end"], "repeated_windows"),
        _counts_text(source, kind, "kind_counts"),
    ]
    one = _beside(parts)
    return one.select(
        "*",
        (F.col("fleet_events") != F.col("source_rows")).alias("fleet_event_mismatch"),
        (F.col("fleet_entities") != F.col("source_entities")).alias("fleet_entity_mismatch"),
        (F.col("fleet_kind_sum") != F.col("fleet_events")).alias("fleet_kind_mismatch"),
        (F.col("window_events") != F.col("source_rows")).alias("window_event_mismatch"),
        F.lit(len(set(named) & set(excluded))).alias("excluded_fields"),
    )


def null_counts(rows: DataFrame) -> DataFrame:
    """Per column its type, nulls and (for numbers) NaNs, from one pass."""
    nan = lambda c, t: F.count_if(F.isnan(c)) if t in ("double", "float") else F.lit(0).cast("bigint")
    one = rows.agg(*(x for i, (c, t) in enumerate(rows.dtypes) for x in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), nan(F.col(f"`{c}`"), t).alias(f"x{i}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(t).alias("type"), F.col(f"n{i}").alias("nulls"), F.col(f"x{i}").alias("nans")) for i, (c, t) in enumerate(rows.dtypes)))))


def stacked(reports: dict[str, DataFrame], name: str, value: str) -> DataFrame:
    """Several reports as one long table (section, name, value as text)."""
    parts = [r.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value")) for section, r in reports.items()]
    return reduce(DataFrame.unionByName, parts)


def identity_hashes(rows: DataFrame, unique: str, order: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row: sha256 of the ids in order and of ids with features in order, as compact JSON. For baselines of bounded size: the whole text stands in one row."""
    got = F.sort_array(F.collect_list(F.struct(*order, *(c for c in [unique, *features] if c not in order))))
    ids = F.to_json(F.transform(got, lambda x: x[unique]))
    full = F.to_json(F.transform(got, lambda x: F.struct(*(x[c].alias(c) for c in sorted([unique, *features])))))
    return rows.agg(F.count("*").alias("n"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(full, 256).alias("features_sha256"))


def worst_first(rows: DataFrame, scope: str, measure: str, name: str) -> DataFrame:
    """Rows with their place in the order of scope, falling measure, name; for reports, which have few rows."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col(scope), F.desc(measure), F.col(name))))


def in_future(rows: DataFrame, column: str, today: Column | None = None) -> DataFrame:
    """Rows whose date lies after ``today`` (the current date by default); a null is not in the future."""
    return rows.where(F.col(column).cast("date") > (F.current_date() if today is None else today))
