"""Data profiles: quality, distributions, balances, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import null_safe_join, quantiles


def quality(rows: DataFrame, unique: str) -> DataFrame:
    """rows, columns, nulls over all columns, fully repeated rows, distinct ids."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in rows.columns), F.lit(0))
    base = rows.agg(F.count("*").alias("n_rows"), F.lit(len(rows.columns)).alias("n_columns"), nulls.alias("n_nulls"), F.count_distinct(unique).alias("n_ids"))
    return base.join(rows.distinct().agg(F.count("*").alias("_d"))).select("n_rows", "n_columns", "n_nulls", "n_ids", (F.col("n_rows") - F.col("_d")).alias("duplicate_rows"))


def distribution(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    names = rows.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    found = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("t"))
    return names.join(found, "value", "left").join(F.broadcast(total)).select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("t")), 6), F.lit(0.0)).alias("percentage"))


def class_balance(rows: DataFrame, positive: Column, minority: float = 0.1) -> DataFrame:
    return (
        rows.agg(F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"))
        .withColumn("positive_percentage", F.round(F.try_divide(100.0 * F.col("positives"), F.col("positives") + F.col("negatives")), 6))
        .withColumn("ratio", F.round(F.try_divide(F.col("positives").cast("double"), F.col("negatives")), 6))
        .withColumn("imbalanced", F.coalesce(F.col("positive_percentage") < 100 * minority, F.lit(False)))
    )


def group_rates(rows: DataFrame, group: str, positive: Column) -> DataFrame:
    """Per group: rows, positives, share of all rows, rate."""
    got = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(positive).alias("positives"))
    total = rows.agg(F.count("*").alias("t"))
    return got.join(F.broadcast(total)).select(group, "n", "positives", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("share"), F.round(100.0 * F.col("positives") / F.col("n"), 6).alias("rate"))


def flag_overlap(rows: DataFrame, flags: Sequence[Column]) -> DataFrame:
    active = sum((f.cast("int") for f in flags), F.lit(0))
    return rows.select(active.alias("a")).agg(F.count_if(F.col("a") == 0).alias("none"), F.count_if(F.col("a") == 1).alias("one"), F.count_if(F.col("a") > 1).alias("several"))


def mode_counts(rows: DataFrame, target: Column, modes: dict[str, Column]) -> DataFrame:
    """Per mode: positives, and their share of all rows and of the target's rows."""
    one = rows.agg(F.count("*").alias("n"), F.count_if(target).alias("t"), *(F.count_if(c).alias(f"m_{k}") for k, c in modes.items()))
    parts = F.array(*(F.struct(F.lit(k).alias("mode"), F.col(f"m_{k}").alias("positives"), F.round(F.try_divide(100.0 * F.col(f"m_{k}"), F.col("n")), 6).alias("of_rows"), F.round(F.try_divide(100.0 * F.col(f"m_{k}"), F.col("t")), 6).alias("of_target")) for k in modes))
    return one.select(F.inline(parts))


def crosstab(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def long_form(rows: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return rows.select(*keep, F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))))


def describe(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample deviation and quartiles (linear interpolation) per feature, optionally per group."""
    long = long_form(rows, columns, by)
    got = long.groupBy(*by, "feature").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    got = null_safe_join(got, quantiles(long, [*by, "feature"], "x", (0.25, 0.5, 0.75)), [*by, "feature"], "left")
    return got.select(*by, "feature", "n", "mean", "std", "min", *(F.round(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate((25, 50, 75))), "max")


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the Pearson matrix, one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*(F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def strongest(correlation: DataFrame, target: str, n: int = 3) -> DataFrame:
    other = F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a"))
    return correlation.where((F.col("a") == target) | (F.col("b") == target)).select(other.alias("feature"), "r").orderBy(F.abs("r").desc_nulls_last(), "feature").limit(n)


def raw_contract(rows: DataFrame, ids: str, columns: dict[str, str]) -> DataFrame:
    """One row about text columns: empty fields, and values per column that do not read as the type it should have."""
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"bad_{c}") for c, t in columns.items()]
    empty = sum((F.count_if(F.coalesce(F.trim(c), F.lit("")) == "") for c in columns), F.lit(0))
    return rows.agg(F.count("*").alias("n_rows"), empty.alias("n_empty"), (F.count(ids) - F.count_distinct(ids)).alias("repeated_ids"), *bad)


def raw_fields(rows: DataFrame, rules: dict[str, tuple[str, float, float]]) -> DataFrame:
    """A row per text column: empty fields, fields not of their kind (integer, number, binary), extremes, fields out of their range (both ends allowed)."""

    def one(c: str, kind: str, low: float, high: float) -> Column:
        text = F.trim(c)
        empty = F.coalesce(text, F.lit("")) == ""
        number = text.try_cast("double")
        of_kind = {"integer": text.rlike(r"^[+-]?[0-9]+$"), "number": ~F.isnan(number) & (F.abs(number) < float("inf")), "binary": text.isin("0", "1")}[kind]
        fits = ~empty & F.coalesce(of_kind, F.lit(False))
        return F.struct(
            F.lit(c).alias("feature"),
            F.count_if(empty).alias("empty"),
            F.count_if(~empty & ~fits).alias("not_of_kind"),
            F.min(F.when(fits, number)).alias("least"),
            F.max(F.when(fits, number)).alias("greatest"),
            F.count_if(fits & ~number.between(low, high)).alias("out_of_range"),
        )

    return rows.agg(F.array(*(one(c, *r) for c, r in rules.items())).alias("_all")).select(F.inline("_all"))


def header_faults(header: Sequence[str], expected: Sequence[str]) -> dict[str, list[str]]:
    """Names that a header lacks, has beyond the expected ones, has twice, or has in another order."""
    missing, more = [c for c in expected if c not in header], [c for c in header if c not in expected]
    both, wanted = [c for c in dict.fromkeys(header) if c in expected], [c for c in expected if c in header]
    return {"missing": missing, "unexpected": more, "repeated": sorted({c for c in header if list(header).count(c) > 1}), "misplaced": [a for a, b in zip(both, wanted, strict=True) if a != b]}


def id_gaps(rows: DataFrame, column: str, first: int, last: int) -> DataFrame:
    return rows.sparkSession.range(first, last + 1).withColumnRenamed("id", column).join(rows.select(F.col(column).cast("bigint").alias(column)), column, "left_anti")
