"""Population-stability drift between a reference and a current table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import quantiles
from tidemark.operators.profile import long_form

# Number of quantile bins, added to proportions, and the inclusive bounds of the states.
BINS, EPSILON, WATCH, DRIFT = 10, 1e-6, 0.1, 0.25


def status(psi: Column) -> Column:
    return F.when(psi >= DRIFT, F.lit("drift")).when(psi >= WATCH, F.lit("watch")).otherwise(F.lit("stable"))


def _psi_term(r: Column, c: Column) -> Column:
    return (c - r) * F.ln((c + EPSILON) / (r + EPSILON))


def bin_edges(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, edges (distinct linear quantiles of the reference)."""
    found = quantiles(long_form(reference, features), ["feature"], "x", [i / BINS for i in range(BINS + 1)])
    return found.select("feature", F.array_distinct("q").alias("edges"))


def proportions(rows: DataFrame, features: Sequence[str], edges: DataFrame) -> DataFrame:
    """feature, bin, p: shares of bins [a, b); the outer bins are open to both sides."""
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    placed = long_form(rows, features).join(F.broadcast(edges), "feature").where("x IS NOT NULL").select("feature", F.size(F.filter(inner, lambda e: e <= F.col("x"))).alias("bin"))
    counts = placed.groupBy("feature", "bin").agg(F.count("*").alias("n"))
    return counts.select("feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("p"))


def _stats(rows: DataFrame, features: Sequence[str], side: str) -> DataFrame:
    return long_form(rows, features).groupBy("feature").agg(F.count("x").alias(f"{side}_count"), F.avg("x").alias(f"{side}_mean"), F.stddev_pop("x").alias(f"{side}_std"), F.min("x").alias(f"{side}_min"), F.max("x").alias(f"{side}_max"))


def numeric_drift(reference: DataFrame, current: DataFrame, features: Sequence[str], digits: int = 6) -> DataFrame:
    """Per feature: PSI (never below 0), state, both sides' statistics, standardised mean shift, and values outside the reference range."""
    edges = bin_edges(reference, features)
    r, c = proportions(reference, features, edges).withColumnRenamed("p", "r"), proportions(current, features, edges).withColumnRenamed("p", "c")
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    psi = r.join(c, ["feature", "bin"], "full_outer").groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(_psi_term(zero("r"), zero("c")))).alias("psi"))
    a, b = _stats(reference, features, "reference"), _stats(current, features, "current")
    outside = long_form(current, features).join(F.broadcast(a), "feature").groupBy("feature").agg(F.count_if((F.col("x") < F.col("reference_min")) | (F.col("x") > F.col("reference_max"))).alias("outside_count"))
    out = psi.join(a, "feature").join(b, "feature").join(outside, "feature")
    shift = F.when(F.col("reference_std") > 0, (F.col("current_mean") - F.col("reference_mean")) / F.col("reference_std"))
    numbers = [F.round(x, digits).alias(n) for n, x in (("psi", F.col("psi")), *((f"{s}_{k}", F.col(f"{s}_{k}")) for s in ("reference", "current") for k in ("mean", "std")), ("mean_shift", shift), ("outside_rate", F.try_divide(F.col("outside_count").cast("double"), F.col("current_count"))))]
    return out.select("feature", "reference_count", "current_count", "outside_count", *numbers, status(F.col("psi")).alias("status"))


def category_shares(reference: DataFrame, current: DataFrame, column: str, domain: Sequence[str], digits: int = 6) -> DataFrame:
    """Per category of the domain its share of all rows on either side (0 for a side without rows)."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        one = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(column) == v).alias(f"c{i}") for i, v in enumerate(domain)))
        share = lambda i: F.round(F.coalesce(F.try_divide(F.col(f"c{i}").cast("double"), F.col("n")), F.lit(0.0)), digits)
        return one.select(F.inline(F.array(*(F.struct(F.lit(v).alias("category"), share(i).alias(name)) for i, v in enumerate(domain)))))

    return side(reference, "reference").join(side(current, "current"), "category")


def categorical_drift(reference: DataFrame, current: DataFrame, column: str, domain: Sequence[str], digits: int = 6) -> DataFrame:
    """One row: PSI over the fixed domain (shares of all rows, unexpected ones included), and how many values were unexpected."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        known = F.coalesce(F.col(column).isin(*domain), F.lit(False))
        return rows.agg(F.count("*").alias(f"{name}_count"), F.count_if(~known).alias(f"{name}_unexpected"), *(F.count_if(F.col(column) == v).alias(f"{name}_{i}") for i, v in enumerate(domain)))

    both = side(reference, "r").join(side(current, "c"))
    share = lambda s, i: F.coalesce(F.try_divide(F.col(f"{s}_{i}").cast("double"), F.col(f"{s}_count")), F.lit(0.0))
    psi = F.greatest(F.lit(0.0), sum((_psi_term(share("r", i), share("c", i)) for i in range(len(domain))), F.lit(0.0)))
    return both.select(F.lit(column).alias("feature"), F.col("r_count").alias("reference_count"), F.col("c_count").alias("current_count"), F.col("c_unexpected").alias("unexpected_count"), F.round(psi, digits).alias("psi"), status(psi).alias("status"))


def overall(metrics: DataFrame) -> DataFrame:
    """One row: the worst state, counts by state and the feature of the highest PSI (ties: least name)."""
    rank = F.when(F.col("status") == "drift", 2).when(F.col("status") == "watch", 1).otherwise(0)
    worst = F.max(rank)
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    first = F.min_by("feature", F.struct(-F.col("psi"), F.col("feature")))
    return metrics.agg(F.when(worst == 2, F.lit("drift")).when(worst == 1, F.lit("watch")).otherwise(F.lit("stable")).alias("overall_status"), count("stable"), count("watch"), count("drift"), first.alias("highest_psi_feature"), F.max("psi").alias("highest_psi"))


def state_summary(snapshots: DataFrame, metrics: DataFrame, identity: Sequence[str], scopes: Sequence[str], snapshot: str = "snapshot_id") -> DataFrame:
    """One row: snapshots, metrics per status, the highest PSI of each scope (ties go to the lesser name), and identities that occur twice.

    ``metrics``: snapshot, scope, feature_name, psi, status; only those of the given snapshots count.
    """
    own = metrics.join(snapshots.select(snapshot).distinct(), snapshot, "left_semi")
    twice = lambda rows, keys, name: rows.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias(name))
    # the least of (-psi, name) is the highest PSI with the lesser name
    best = lambda s: F.min(F.when((F.col("scope") == s) & F.col("psi").isNotNull(), F.struct((-F.col("psi")).alias("_down"), "feature_name", "psi", "status")))
    counts = own.agg(F.count("*").alias("feature_metric_count"), *(F.count_if(F.col("status") == s).alias(s) for s in ("stable", "watch", "drift")), *(best(s).alias(f"_{s}") for s in scopes))
    highest = [F.col(f"_{s}.{c}").alias(f"highest_{s}_{c}") for s in scopes for c in ("feature_name", "psi", "status")]
    parts = [snapshots.agg(F.count("*").alias("snapshot_count")), counts.select("feature_metric_count", "stable", "watch", "drift", *highest), twice(snapshots, identity, "repeated_snapshots"), twice(own, [snapshot, "scope", "feature_name"], "repeated_metrics")]
    return reduce(DataFrame.join, parts)
