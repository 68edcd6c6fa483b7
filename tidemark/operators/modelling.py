"""Classifiers on tabular rows with MLlib, cross-validated scores, and isolation scores.

Fitted numbers depend on the library's own randomness; what is fixed here are the contracts: every row is
scored once out of fold, and a decision is taken on the same six-digit probability that is reported.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluation import folds
from tidemark.sources.scratch import written


def pipeline(kind: str, categorical: Sequence[str], numeric: Sequence[str], label: str, seed: int = 42) -> Pipeline:
    """One-hot categories and (for the linear model) standardised numbers, then the classifier: logistic, forest or boosted."""
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical], dropLast=False)
    raw = VectorAssembler(inputCols=list(numeric), outputCol="_numbers", handleInvalid="error")
    stages = [*([index, hot] if categorical else []), raw]
    numbers = "_numbers"
    if kind == "logistic":
        stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True))
        numbers = "_scaled"
    stages.append(VectorAssembler(inputCols=[*(f"_h_{c}" for c in categorical), numbers], outputCol="_features"))
    common = {"featuresCol": "_features", "labelCol": label}
    made = {"logistic": lambda: LogisticRegression(maxIter=50, **common), "forest": lambda: RandomForestClassifier(numTrees=50, seed=seed, **common), "boosted": lambda: GBTClassifier(maxIter=20, seed=seed, **common)}
    return Pipeline(stages=[*stages, made[kind]()])


def probability(scored: DataFrame) -> Column:
    return F.round(vector_to_array("probability")[1], 6)


def prior(rows: DataFrame, label: str) -> DataFrame:
    """One row: the share of positives, the baseline's constant score, and the weight of a positive."""
    y = F.col(label) == 1
    return rows.agg(F.round(F.avg(y.cast("double")), 6).alias("prior_probability"), F.round(F.try_divide(F.count_if(~y).cast("double"), F.count_if(y)), 6).alias("positive_weight"))


def out_of_fold(rows: DataFrame, make: Callable[[], Pipeline], label: str, order: Sequence[Column], keep: Sequence[str], k: int = 5) -> DataFrame:
    """Every row with the probability of a model that has not seen it."""
    parted = written(folds(rows, label, order, k), "folds")  # read 2k times
    parts = []
    for i in range(k):
        model = make().fit(parted.where(F.col("fold") != i))
        scored = model.transform(parted.where(F.col("fold") == i))
        parts.append(scored.select(*keep, label, "fold", probability(scored).alias("probability")))
    return reduce(DataFrame.unionByName, parts)


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """Decision on the reported probability."""
    return scored.withColumn("failure_prediction", (F.col("probability") >= threshold).cast("int")).withColumn("frozen_threshold", F.lit(threshold))


def inference_outputs(scored: DataFrame, threshold: float, **identity: str) -> DataFrame:
    """Outputs of batch inference: the probability to six digits, the decision on the unrounded one, the threshold, and the model's identity."""
    p = F.col("probability").cast("double")
    return scored.select(*(c for c in scored.columns if c != "probability"), F.round(p, 6).alias("failure_probability"), (p >= threshold).cast("int").alias("failure_prediction"), F.lit(threshold).alias("decision_threshold"), *(F.lit(v).alias(k) for k, v in identity.items()))


#: Rows of one isolation tree.
TREE_ROWS = 256


def tree_samples(rows: DataFrame, keys: Sequence[str], features: Sequence[str], trees: int = 100, size: int = TREE_ROWS, seed: int = 42) -> list[np.ndarray]:
    """For each tree ``size`` rows drawn from all rows by a seeded hash of keys, features and the number of a copy, whatever the partitioning.

    A tree takes its rows of least hash. Only hashes below a bound that four times ``size`` rows are expected to pass go on,
    so what is put in order and what comes to the driver does not grow with the table.
    """
    n = rows.count()
    named = list(dict.fromkeys([*keys, *features]))
    # rows equal in keys and features are numbered, a thousand at a time, so that they are drawn one by one
    counted = rows.groupBy(*named).agg(F.count("*").alias("_n")).withColumn("_first", F.explode(F.expr("sequence(1L, _n, 1000L)")))
    copies = counted.withColumn("_copy", F.explode(F.expr("sequence(_first, least(_n, _first + 999L))")))
    base = copies.select(*features, F.xxhash64(F.lit(seed), "_copy", *(F.col(c).isNull() for c in named), *named).alias("_h"))
    bound = 2**63 - 1 if n <= 4 * size else int(2**64 * (4 * size / n)) - 2**63
    numbers = F.broadcast(rows.sparkSession.range(trees).withColumnRenamed("id", "_tree"))
    drawn = base.join(numbers, F.xxhash64("_h", "_tree") <= F.lit(bound)).withColumn("_d", F.xxhash64("_h", "_tree"))
    least = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("_tree").orderBy("_d", *features))).where(F.col("_r") <= size)
    got = least.orderBy("_tree", "_r").select("_tree", *features).toPandas()
    x, of = got[list(features)].to_numpy(float), got["_tree"].to_numpy()
    return [x[of == t] for t in range(trees)]


def fit_isolation(sample: np.ndarray, trees: int = 100, size: int = TREE_ROWS, seed: int = 42) -> list[list[tuple]]:
    """Isolation trees over rows held here, each on its own draw; nodes are (feature, cut, left, right) or (None, rows)."""
    rng = np.random.default_rng(seed)
    size = min(size, len(sample))
    return [_grown(sample[rng.choice(len(sample), size, replace=False)], rng) for _ in range(trees)]


def fit_trees(samples: Sequence[np.ndarray], seed: int = 42) -> list[list[tuple]]:
    """One isolation tree for each of ``samples``."""
    rng = np.random.default_rng(seed)
    return [_grown(x, rng) for x in samples]


def _grown(sample: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    height = int(np.ceil(np.log2(max(2, len(sample)))))
    nodes: list[tuple] = []

    def grow(x: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((None, len(x)))
        spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else np.array([], int)
        if depth < height and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            nodes[at] = (f, cut, grow(x[x[:, f] < cut], depth + 1), grow(x[x[:, f] >= cut], depth + 1))
        return at

    grow(sample, 0)
    return nodes


def _expected(n: np.ndarray | float) -> np.ndarray:
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _flat(nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree in arrays: feature, cut, children (right at 2i, left at 2i + 1; a leaf is its own child), path length at leaves, height."""
    n = len(nodes)
    feature, cut, child = np.zeros(n, np.intp), np.zeros(n), np.repeat(np.arange(n), 2)
    length, level = np.zeros(n), np.zeros(n, np.intp)
    for at, node in enumerate(nodes):
        if node[0] is None:
            length[at] = level[at] + _expected(node[1])
        else:
            feature[at], cut[at], left, right = node
            child[2 * at], child[2 * at + 1] = right, left
            level[left] = level[right] = level[at] + 1
    return feature, cut, child, length, int(level.max())


def path_lengths(x: np.ndarray, forest: Sequence[tuple]) -> np.ndarray:
    """Sum over the trees (``_flat``) of each row's path length; all rows go down one level at a time. A NaN is not below any cut."""
    total, values = np.zeros(len(x)), np.ascontiguousarray(x).ravel()
    row = np.arange(len(x)) * x.shape[1]
    for feature, cut, child, length, height in forest:
        node = np.zeros(len(x), np.intp)
        for _ in range(height):
            node = child[2 * node + (values[row + feature[node]] < cut[node])]
        total += length[node]
    return total


def isolation_scores(rows: DataFrame, forest: list[list[tuple]], features: Sequence[str], size: int = TREE_ROWS) -> DataFrame:
    """``rows`` with ``isolation_score``: 0 to 1, higher for rows that fewer cuts set apart."""
    sent = rows.sparkSession.sparkContext.broadcast([_flat(nodes) for nodes in forest])

    def run(batches):
        for batch in batches:
            depth = path_lengths(batch[list(features)].to_numpy(float), sent.value)
            out = batch.copy()
            out["isolation_score"] = np.round(2.0 ** (-depth / max(1, len(sent.value)) / max(1e-9, float(_expected(size)))), 5)
            yield pd.DataFrame(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, isolation_score double")
