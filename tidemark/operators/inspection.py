"""Reports on finished tables and the checks that gate them: one pass per table, null-safe comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import differs
from tidemark.operators.ordered import null_safe_join


def score_summary(rows: DataFrame, unique: str, entity: str, score: Column, decision: Column, digits: int = 6) -> DataFrame:
    """One row about scored records: counts, distinct records and entities, decisions, and the scores' range and mean."""
    return rows.agg(
        F.count("*").alias("records"),
        F.count_distinct(unique).alias("distinct_records"),
        F.count_distinct(entity).alias("entities"),
        F.count_if(decision).alias("positives"),
        F.count_if(~decision).alias("negatives"),
        *(F.round(f(score), digits).alias(f"{n}_score") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))),
    )


def table_report(rows: DataFrame, unique: str, required: Sequence[str], numbers: Sequence[str], partition: Sequence[str]) -> DataFrame:
    """One row: size, repeats of the id, nulls per required column, rows with any null or NaN number, distinct partitions."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in numbers])
    return rows.agg(
        F.count("*").alias("n_rows"),
        (F.count(unique) - F.count_distinct(unique)).alias("repeated_ids"),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_numbers"),
        F.count_distinct(F.struct(*partition)).alias("partitions"),
    )


def numeric_ranges(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column its least and greatest value, long form, from one pass."""
    one = rows.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max")) for c in columns))))


def mismatches(rows: DataFrame, truth: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys of both tables with the names of the columns that differ; a null differs from any value."""
    other = truth.select(*keys, *(F.col(c).alias(f"_w_{c}") for c in columns))
    wrong = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_w_{c}")), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    return null_safe_join(rows.select(*keys, *columns), other, keys).select(*keys, wrong.alias("differing")).where(F.size("differing") > 0)


def differing_values(adapted: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of both tables whose value is not the source's, with both values."""
    other = source.select(key, F.col(column).alias("source_value"))
    both = adapted.select(key, F.col(column).alias("adapted_value")).join(other, key)
    return both.where(differs(F.col("adapted_value"), F.col("source_value")))


def delivery(expected: DataFrame, arrived: DataFrame, keys: Sequence[str], order: Sequence[str], payload: str) -> DataFrame:
    """Expected keys with ``state`` (matched, missing, differs) and how often they arrived; the first arrival counts, others are ignored."""
    first = arrived.groupBy(*keys).agg(F.count("*").alias("arrivals"), F.min_by(payload, F.struct(*order)).alias("_got"))
    joined = expected.select(*keys, payload).join(first, list(keys), "left")
    state = F.when(F.col("arrivals").isNull(), "missing").when(F.col(payload).eqNullSafe(F.col("_got")), "matched").otherwise("differs")
    return joined.select(*keys, state.alias("state"), F.coalesce("arrivals", F.lit(0)).alias("arrivals"))


def summary_invariants(entities: DataFrame, windows: DataFrame, fleet: DataFrame, entity: str, count: str = "event_count") -> DataFrame:
    """One row: do the three summaries keep their grains and count the same events?"""
    total = lambda rows, name: rows.agg(F.count("*").alias(f"{name}_rows"), F.coalesce(F.sum(count), F.lit(0)).alias(f"{name}_events"))
    a = entities.agg(F.count("*").alias("entity_rows"), F.count_distinct(entity).alias("entities"), F.coalesce(F.sum(count), F.lit(0)).alias("entity_events"))
    w = windows.groupBy(entity, "window_start").agg(F.count("*").alias("_n"), F.sum(count).alias("_c")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("window_rows"), F.count_if(F.col("_n") > 1).alias("repeated_windows"), F.coalesce(F.sum("_c"), F.lit(0)).alias("window_events"))
    one = a.join(w).join(total(fleet, "fleet"))
    holds = (F.col("entity_rows") == F.col("entities")) & (F.col("repeated_windows") == 0) & (F.col("fleet_rows") == 1) & (F.col("entity_events") == F.col("fleet_events")) & (F.col("window_events") == F.col("fleet_events"))
    return one.withColumn("holds", holds)


def export_parity(source: DataFrame, export: DataFrame, unique: str, excluded: Sequence[str]) -> DataFrame:
    """One row: an export has its source's rows, each id once, and none of the excluded fields."""
    a = source.agg(F.count("*").alias("source_rows"))
    b = export.agg(F.count("*").alias("export_rows"), F.count_distinct(unique).alias("export_ids"))
    kept = sorted(set(excluded) & set(export.columns))
    one = a.join(b).withColumn("leaked_fields", F.lit(",".join(kept)))
    return one.withColumn("holds", (F.col("source_rows") == F.col("export_rows")) & (F.col("export_ids") == F.col("export_rows")) & (F.col("leaked_fields") == ""))


def split_integrity(rows: DataFrame, unique: str, label: Column, shares: Mapping[str, float], tolerance: float = 0.01) -> DataFrame:
    """Per split: rows, share of all, positive rate, and whether size (within a row per class) and rate (within the tolerance) are as planned and no id stands twice or in another split."""
    per = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(unique).alias("ids"), F.count_if(label).alias("positives"))
    whole = rows.agg(F.count("*").alias("_all"), F.count_if(label).alias("_pos"))
    elsewhere = rows.groupBy(unique).agg(F.collect_set("split").alias("_in")).where(F.size("_in") > 1).select(F.explode("_in").alias("split")).groupBy("split").agg(F.count("*").alias("_shared"))
    per = per.join(elsewhere, "split", "left")
    plan = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))
    rate = F.col("positives") / F.col("n")
    fits = (F.abs(F.col("n") - plan[F.col("split")] * F.col("_all")) <= 2) & (F.abs(rate - F.col("_pos") / F.col("_all")) <= tolerance) & (F.col("n") == F.col("ids")) & F.col("_shared").isNull()
    return per.join(F.broadcast(whole)).select("split", "n", "positives", F.round(rate, 6).alias("rate"), F.coalesce(fits, F.lit(False)).alias("holds"))


def additivity(contributions: DataFrame, row: str, value: str, outputs: DataFrame, base: str, output: str, tolerance: float = 1e-6) -> DataFrame:
    """Per explained row: the sum of its contributions, its distance from output - base, and whether that is within the tolerance."""
    sums = contributions.groupBy(row).agg(F.sum(F.col(value).cast("double")).alias("_s"))
    error = F.abs(F.col("_s") + F.col(base) - F.col(output))
    return outputs.join(sums, row).select(row, F.round("_s", 6).alias("contribution_sum"), (error <= tolerance).alias("additive"))


def ledger(runs: DataFrame, run: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Runs as a long key/value table (run columns, key, value text), to be merged by identity."""
    return runs.select(*run, F.inline(F.array(*(F.struct(F.lit(v).alias("key"), F.col(v).cast("string").alias("value")) for v in values)))).where("value IS NOT NULL")


def top_per_group(rows: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; every task keeps no more than ``n`` rows of a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def grid_ranking(trials: DataFrame, score: str, name: str) -> DataFrame:
    """Trials with their rank by score (ties share the least rank) and their place after ties are broken by name. For grids, not for corpora."""
    return trials.select("*", F.rank().over(Window.orderBy(F.col(score).desc())).alias("rank"), F.row_number().over(Window.orderBy(F.col(score).desc(), name)).alias("place"))


def chart_series(rows: DataFrame, time: str, value: str, flag: Column) -> DataFrame:
    """Points (epoch milliseconds, value, flagged) of the rows that have both a time and a value, in time order."""
    at = F.unix_millis(F.col(time).cast("timestamp"))
    return rows.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(at.alias("at_ms"), F.col(value).alias("value"), F.coalesce(flag, F.lit(False)).alias("flagged")).orderBy("at_ms", "value")


def status_counts(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per status of each table, stacked."""
    return reduce(DataFrame.unionByName, [df.groupBy(F.col(c).alias("status")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "status", "n") for name, (df, c) in tables.items()])
