"""Running totals and exact quantiles over groups of any size.

Up to ``ONE_TASK`` rows a plain window or ``percentile`` is the fastest plan, but both hold a whole group in one
task. Beyond that the rows are dealt out by ranges of their order, each range adds up its own rows, and a running
total over the ranges (as many rows as there are ranges) shifts them. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

#: Rows that one task may sort or hold as one group.
ONE_TASK = 5_000_000


def null_safe_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet; the keys of ``rows`` stay."""
    other = small.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(other[f"_j_{k}"]) for k in keys], F.lit(True))
    return rows.join(other, on, how).drop(*(f"_j_{k}" for k in keys))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], totals: Mapping[str, Column], one_task: int = ONE_TASK) -> DataFrame:
    """``rows`` with running totals within each ``by`` group (null is a group). ``order`` must leave no ties; a total of 1 is the row number."""
    by = list(by)
    n = rows.count()
    if n <= one_task:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("*", *(F.sum(c).over(w).alias(t) for t, c in totals.items()))
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // one_task))
    dealt = rows.select("*", *(c.alias(f"_v_{t}") for t, c in totals.items())).repartitionByRange(ranges, *map(F.col, by), *order)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    part = dealt.groupBy(*by, "_range").agg(*(F.sum(f"_v_{t}").alias(f"_p_{t}") for t in totals))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = part.select(*by, "_range", *(F.coalesce(F.sum(f"_p_{t}").over(earlier), F.lit(0)).alias(f"_b_{t}") for t in totals))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select(*rows.columns, "_range", *(F.sum(f"_v_{t}").over(inside).alias(f"_l_{t}") for t in totals))
    return null_safe_join(local, before, [*by, "_range"]).select(*rows.columns, *((F.col(f"_l_{t}") + F.col(f"_b_{t}")).alias(t) for t in totals))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float], one_task: int = ONE_TASK) -> DataFrame:
    """``by`` and ``q``: the exact quantiles (linear interpolation) of the non-null values, as an array; a group without values has no row."""
    by = list(by)
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    if rows.count() <= one_task:
        return rows.groupBy(*by).agg(F.percentile("_x", F.array(*map(F.lit, at))).alias("q"), F.count("*").alias("_n")).where("_n > 0").drop("_n")
    counts = rows.groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    reached = running(counts, by, [F.col("_x")], {"_upto": F.col("_n")}, one_task)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    # the value at a rank is the least one whose running count exceeds it
    place = [F.lit(float(q)) * (F.col("_all") - 1) for q in at]
    least = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_x")))
    found = null_safe_join(reached, sizes, by).groupBy(*by).agg(F.max("_all").alias("_all"), *(f(p).alias(f"_{k}{i}") for i, p in enumerate(place) for k, f in (("lo", lambda p: least(F.floor(p))), ("hi", lambda p: least(F.ceil(p))))))
    return found.select(*by, F.array(*(F.col(f"_lo{i}") + (p - F.floor(p)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i, p in enumerate(place))).alias("q"))
