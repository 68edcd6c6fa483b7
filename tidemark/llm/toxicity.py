"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, word pairs and pairs one word apart are hashed to 2**20 coordinates, each counted once per text.
Every coordinate has its own learning rate; L1 leaves most weights at zero, so what the scorers receive
is a short list, at most one entry per coordinate.

The model is fitted on at most about ``MAX_TRAIN`` labelled rows, taken by a hash of the id; the bound
does not depend on the corpus. Scoring reads every whole text.

Defined results: a text without words (null, empty) has the score of the fitted bias; unlabelled, null
and held-out labels are not learnt from; a document with unequal labels counts as toxic; without any label the score is below one half; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbatch import ALNUM, LOWER, PrefixHash, bound_batches, chunks, give_back, mix, utf8, words

BITS = 20
MAX_TRAIN = 20_000
FOLDS = 5


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 8


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a chunk of texts and their documents; repeats included."""
    data = LOWER[data]
    start, end, doc = words(data, offsets, ALNUM)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = PrefixHash(data).of(start, end)
    shift = np.uint64(64 - BITS)
    out, owner = [w >> shift], [doc]
    for gap, a, b in ((1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        if len(w) > gap:
            same = doc[gap:] == doc[:-gap]
            out.append((mix(w[:-gap] * np.uint64(a) + w[gap:] * np.uint64(b)) >> shift)[same])
            owner.append(doc[gap:][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


def _fit(rows: list[np.ndarray], labels: list[int], how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """rows: distinct coordinates of each text. Coordinates with a weight, their weights, and the bias."""
    y = np.asarray(labels, float)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, seen = float(np.log((y.sum() + 0.1) / (len(y) - y.sum() + 1.0))), 1.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= how.l1, 0.0, (np.sign(zi) * how.l1 - zi) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2))

    order = np.arange(len(rows))
    for epoch in range(how.epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            at = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha * w
            n[at] = ni + g * g
            seen += g * g
            bias -= how.alpha / (how.beta + np.sqrt(seen)) * g
    w = weights(z, n)
    held = np.flatnonzero(w)
    return held, w[held], bias


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", how: Ftrl = Ftrl(), max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (coordinates, values) and bias from a bounded sample of the labelled rows that are not held out."""
    bound_batches(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    n = rows.count()
    share = min(1.0, max_train / max(1, n))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # the sample's size is bounded by max_train, so it may be sent to every task
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rows), "id").select("id", "text", "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys += [(str(i), zlib.crc32((t or "").encode()), y) for i, t, y in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "label")), strict=True)]
            for k in range(batch.num_rows):
                one = data[offsets[k] : offsets[k + 1]]
                rows.append(np.unique(features(one, np.array([0, len(one)]))[0]).astype(np.int32))
            give_back()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        at, w, bias = _fit([rows[i] for i in order], [keys[i][2] for i in order], how)
        del rows, keys
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], names=["at", "w"])

    model = joined.repartition(1).mapInArrow(fit, "at bigint, w double").collect()
    at, w = np.array([m[0] for m in model], np.int64), np.array([m[1] for m in model])
    last = at < 0
    return at[~last], w[~last], float(w[last][0]) if last.any() else float(np.log(0.1))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep`` columns and score of every row."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = [F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))]
    rows = docs.select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if keep or f.name == "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        table = np.zeros(1 << BITS)
        table[at] = values
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            got = np.full(batch.num_rows, bias)
            for a, b in chunks(offsets):
                x, doc = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held = table[x] != 0
                once = np.unique(doc[held] << BITS | x[held])
                got[a:b] += np.bincount(once >> BITS, table[once & ((1 << BITS) - 1)], b - a)
            names = [c for c in batch.schema.names if keep or c == "_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(1.0 / (1.0 + np.exp(-np.clip(got, -35, 35))))], names=[*names, "score"])
            give_back()

    out = rows.mapInArrow(run, schema + ", score double").withColumnRenamed("_id", id_col)
    if keep:
        out = out.withColumnRenamed("_text", text_col)
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"_k{i}", c)
    return out
