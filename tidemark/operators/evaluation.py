"""Classifier evaluation, thresholds, splits and feature importance over scored rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp
from tidemark.operators.ordered import ONE_TASK, null_safe_join, running


def _rates(rows: DataFrame, digits: int) -> DataFrame:
    """Metrics from tp, fp, fn, tn; a zero denominator gives 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f_beta = lambda b2: ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)
    values = {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f_beta(1), "f2": f_beta(4)}
    return rows.select("*", *(F.round(v, digits).alias(k) for k, v in values.items()))


def threshold_sweep(rows: DataFrame, label: str, score: str, steps: int = 100, digits: int = 6) -> DataFrame:
    """Metrics at 0.01 .. 0.99 (decision score >= threshold).

    Each row falls into the bucket of the highest threshold it reaches; one aggregation over buckets and a
    cumulative sum over at most 100 rows replace the product of rows and thresholds. Rows without score (null,
    NaN) or label count nowhere.
    """
    return _sweep(rows.select(F.lit(score).alias("model"), F.col(label).alias("label"), F.col(score).cast("double").alias("score")), [score], steps, digits).drop("model")


def model_sweeps(rows: DataFrame, label: str, scores: Sequence[str], steps: int = 100, digits: int = 6) -> DataFrame:
    """``threshold_sweep`` of several models, each with its score column, in one pass over the rows: model, threshold and metrics."""
    each = F.array(*(F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores))
    return _sweep(rows.select(F.col(label).alias("label"), F.inline(each)), scores, steps, digits)


def _sweep(rows: DataFrame, models: Sequence[str], steps: int, digits: int) -> DataFrame:
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isNotNull())
    # a product may round to the other side of a threshold, so the score itself is compared with its neighbours
    near = F.greatest(F.lit(-1), F.least(F.lit(steps), F.floor(F.col("score") * steps)))
    reached = near + F.when(F.col("score") < near / F.lit(float(steps)), -1).when(F.col("score") >= (near + 1) / F.lit(float(steps)), 1).otherwise(0)
    bucket = F.greatest(F.lit(0), F.least(F.lit(steps - 1), reached)).cast("int")
    counts = rows.select("model", bucket.alias("b"), (F.col("label") == 1).alias("y")).groupBy("model", "b").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q"))
    grid = rows.sparkSession.range(0, steps).select(F.explode(F.array(*map(F.lit, models))).alias("model"), F.col("id").cast("int").alias("b"))
    grid = grid.join(counts, ["model", "b"], "left").select("model", "b", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    every = Window.partitionBy("model")
    above = every.orderBy(F.col("b").desc())
    grid = grid.select("model", "b", F.sum("p").over(above).alias("tp"), F.sum("q").over(above).alias("fp"), F.sum("p").over(every).alias("all_p"), F.sum("q").over(every).alias("all_q")).where("b > 0")
    return _rates(grid.select("model", F.round(F.col("b") / steps, 2).alias("threshold"), "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_q") - F.col("fp")).alias("tn")), digits)


def confusion(rows: DataFrame, label: str, score: str, threshold: float, digits: int = 6) -> DataFrame:
    y, p = F.col(label) == 1, F.col(score) >= threshold
    return _rates(rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")), digits)


def ranking_metrics(rows: DataFrame, label: str, score: str, digits: int = 6) -> DataFrame:
    """One row: ROC AUC (average ranks) and average precision (steps at distinct scores).

    Rows are first counted per distinct score, so that scores are put in order, not rows.
    """
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n"))
    run = running(by, [], [F.col("s").desc()], {"tp": F.col("p"), "k": F.col("n")})
    total = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    both = run.join(F.broadcast(total))
    positives, negatives = F.col("all_p"), F.col("all_n") - F.col("all_p")
    # a positive at a score beats the negatives below it and half of those beside it
    below = negatives - (F.col("k") - F.col("tp"))
    auc = F.try_divide(F.sum(F.col("p") * (below + (F.col("n") - F.col("p")) / 2)), F.max(positives) * F.max(negatives))
    ap = F.sum(F.try_divide(F.col("p").cast("double"), positives) * F.col("tp") / F.col("k"))
    return both.agg(F.round(auc, digits).alias("roc_auc"), F.round(ap, digits).alias("average_precision"))


def best_thresholds(sweep: DataFrame, least_recall: float = 0.70) -> DataFrame:
    """Two rows: the threshold of the highest F2, and of the highest precision among those of enough recall; ties go up."""
    best = lambda m: F.max_by("threshold", F.struct(m, "threshold"))
    a = sweep.agg(best("f2").alias("threshold")).select(F.lit("max_f2").alias("rule"), "threshold")
    b = sweep.where(F.col("recall") >= least_recall).agg(best("precision").alias("threshold")).select(F.lit("precision_at_recall").alias("rule"), "threshold")
    return a.unionByName(b)


def simplest_within(models: DataFrame, name: str, metric: str, order: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """The first model by ``order`` whose metric lies within the tolerance of the best."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    best = models.agg(F.max(metric).alias("_best"))
    return models.join(F.broadcast(best)).where(F.col(metric) >= F.col("_best") - tolerance).agg(F.min_by(name, place).alias("selected"))


def promoted(standing: DataFrame, candidate: DataFrame, metric: str, least_gain: float = 0.005, digits: int = 6) -> DataFrame:
    """Of two one-row tables (model, metric, threshold) the one to use: the candidate only if its metric is higher by ``least_gain`` or more.

    What was measured is compared, what is reported is rounded. A candidate without metric is not promoted.
    """
    both = standing.select(*(F.col(c).alias(f"_s_{c}") for c in ("model", metric, "threshold"))).join(candidate.select("model", metric, "threshold"))
    gain = F.col(metric) - F.col(f"_s_{metric}")
    better = F.coalesce(gain >= least_gain, F.lit(False))
    pick = lambda c: F.when(better, F.col(c)).otherwise(F.col(f"_s_{c}"))
    return both.select(F.round(f"_s_{metric}", digits).alias("standing_metric"), F.round(metric, digits).alias("candidate_metric"), F.round(gain, digits).alias("gain"), better.alias("promoted"), pick("model").alias("selected"), F.round(pick("threshold"), digits).alias("selected_threshold"))


def metric_deltas(a: DataFrame, b: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    l = a.select(*(F.col(c).alias(f"_a_{c}") for c in columns))
    return l.join(b.select(*columns)).select(*(F.round(F.col(c) - F.col(f"_a_{c}"), digits).alias(f"delta_{c}") for c in columns))


def stratified_split(rows: DataFrame, label: str, order: Sequence[Column], shares: Sequence[tuple[str, float]], one_task: int = ONE_TASK) -> DataFrame:
    """Per class, rows in the given pseudo-random order are cut at the cumulative shares (rounded down)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    placed = null_safe_join(running(rows, [label], order, {"_r": F.lit(1)}, one_task), sizes, [label])
    out, reached = F.lit(shares[-1][0]), 0.0
    bounds = []
    for name, share in shares[:-1]:
        reached += share
        bounds.append((name, reached))
    for name, limit in reversed(bounds):
        out = F.when(F.col("_r") <= F.floor(F.round(F.col("_n") * limit, 6)), F.lit(name)).otherwise(out)
    return placed.withColumn("split", out).drop("_r", "_n")


def folds(rows: DataFrame, label: str, order: Sequence[Column], k: int, one_task: int = ONE_TASK) -> DataFrame:
    return running(rows, [label], order, {"_r": F.lit(1)}, one_task).withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r")


def seeded_sample(rows: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows of least seeded hash: the same rows for the same keys, whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def mean_absolute(contributions: DataFrame, feature: str, value: str, digits: int = 6) -> DataFrame:
    """Features ranked by mean absolute contribution, ties by name."""
    got = contributions.groupBy(feature).agg(F.round(F.avg(F.abs(F.col(value).cast("double"))), digits).alias("importance"))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), feature)))


def grouped(contributions: DataFrame, row: str, feature: Column, value: str, digits: int = 6) -> DataFrame:
    """Contributions of a row's features added up per feature group."""
    return contributions.groupBy(row, feature.alias("feature_group")).agg(F.round(F.sum(F.col(value).cast("double")), digits).alias("contribution"))


def normalised_scores(rows: DataFrame, raw: str, low: float, high: float, digits: int = 5) -> DataFrame:
    """(high - x) / (high - low), held to 0..1; null for no value. Bounds must be finite and rising."""
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise ValueError("the least reference value must lie below the greatest")
    return rows.withColumn("anomaly_score", F.round(clamp((F.lit(high) - F.col(raw)) / F.lit(high - low), 0.0, 1.0), digits))


def shared_ids(rows: DataFrame, unique: str, split: str = "split") -> DataFrame:
    """Ids that stand in more than one split, with the splits."""
    found = rows.groupBy(unique).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
    return found.select(unique, F.concat_ws(",", "splits").alias("splits"))


def representatives(rows: DataFrame, score: str, key: str, boundary: float) -> DataFrame:
    """Ids of the lowest, the highest and the row closest to the boundary; ties by key."""
    near = F.abs(F.col(score) - boundary)
    return rows.agg(F.min_by(key, F.struct(score, key)).alias("lowest"), F.min_by(key, F.struct(-F.col(score), F.col(key))).alias("highest"), F.min_by(key, F.struct(near, F.col(key))).alias("closest"))
