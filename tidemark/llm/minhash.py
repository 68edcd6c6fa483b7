"""Near-duplicate groups by min-max hashing: each permutation gives its least and its greatest value.

1. One pass makes, per document, the number of distinct shingles, a 128-bit digest of the set and band
   keys over the min-max signature.
2. Equal sets are one class, led by the smallest id; only leaders go on.
3. Leaders meet the least leader of each of their band buckets; the pairs are checked on full sets.
4. Two documents of one bucket that both fail against its least leader can still be alike. Where those
   who met one leader lie in several components, they are compared with one another on full sets, dealt
   out in blocks of ``BLOCK`` documents or ``BLOCK_BYTES`` of text; a task returns the links that join components, at most one less
   than its documents, never its pairs.
5. Components of the checked links by alternating stars.

Rows per band are fixed and bands follow from the threshold, so that a pair at the threshold shares no
bucket with probability below 1e-7.

Links are confirmed on the words themselves; sets are taken for equal by 128 bits over 64-bit hashes of their shingles.

Defined results: ids are integers (a text that is no number fails); a null or wordless text has no shingles and is linked with nothing; fewer words than a
shingle make one shingle; rows of equal id are one document; a row with a null id is linked with
nothing, its component is null and it is kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.native import small
from tidemark.llm.storage import materialize
from tidemark.llm.textbatch import LOWER, NONSPACE, PrefixHash, bound_batches, chunks, give_back, mix, utf8, words

ROWS = 5
MISS = 1e-7
#: Documents and text bytes of a block, on average; a task compares two blocks at most.
BLOCK = 4_000
BLOCK_BYTES = 8 << 20
#: Pairs whose sets are compared at a time.
PAIRS = 200


def bands_for(percent: int) -> int:
    n = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))
    return n + n % 2


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of lower-cased documents, and their documents; repeats included."""
    start, end, doc = words(data, offsets, NONSPACE)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = PrefixHash(data).of(start, end)
    factors = _constants(width, 7) | np.uint64(1)
    n = len(word)
    total = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.arange(n) - (np.cumsum(total) - total)[doc]
    length = np.minimum(total[doc], width)
    acc = length.astype(np.uint64)
    for k in range(width):
        here = np.zeros(n, np.uint64)
        here[: n - k] = word[k:] * factors[k]
        acc += np.where(k < length, here, np.uint64(0))
    valid = place + length <= total[doc]
    return mix(acc[valid]), doc[valid]


def distinct_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_hashes``, each hash once per document, sorted within it."""
    h, doc = shingle_hashes(data, offsets, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def _sketch(batch: pa.RecordBatch, width: int, bands: int) -> Iterator[pa.RecordBatch]:
    data, offsets = utf8(batch.column("text"))
    perms = bands * ROWS // 2
    factor, flip = _constants(perms, 11) | np.uint64(1), _constants(perms, 13)
    tags = _constants(bands, 17)
    for a, b in chunks(offsets):
        h, doc = distinct_sets(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], width)
        n = np.bincount(doc, minlength=b - a).astype(np.int64)
        some = np.flatnonzero(n)
        digest = np.zeros((2, b - a), np.int64)
        signature = np.zeros((len(some), perms * 2), np.uint64)
        if len(some):
            first = (np.cumsum(n) - n)[some]
            for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
                digest[k, some] = np.add.reduceat(mix(h ^ np.uint64(salt)), first).view(np.int64)
            for i in range(perms):
                v = (h ^ flip[i]) * factor[i]
                signature[:, 2 * i] = np.minimum.reduceat(v, first)
                signature[:, 2 * i + 1] = np.maximum.reduceat(v, first)
        key = np.broadcast_to(tags, (len(some), bands)).copy()
        for r in range(ROWS):
            key = mix(key ^ signature[:, r::ROWS])
        counts = np.where(n > 0, bands, 0)
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(key.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n), pa.array(digest[0]), pa.array(digest[1]), keys], names=["id", "n", "d1", "d2", "keys"])


_FOLD = LOWER.tobytes()


def exact_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The shingle sets of some texts as sorted numbers. Words are named by equality, runs of words by equality of their parts, so equal numbers
    are equal shingles."""
    lists = [t.encode().translate(_FOLD).split() for t in texts]
    sizes = np.array([len(x) for x in lists])
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in texts]
    word = np.empty(sizes.sum(), object)
    word[:] = [w for x in lists for w in x]
    code, names = pd.factorize(word)
    code = code.astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # words from here to the text's end
    run = code.copy()
    for k in range(1, width):
        longer = np.flatnonzero(left > k)
        run[longer] = pd.factorize(run[longer] * len(names) + code[longer + k])[0]
    length = np.minimum(sizes, width)[doc]
    whole = left >= length
    out = np.unique(np.stack([doc[whole], run[whole] * (width + 1) + length[whole]]), axis=1) if whole.any() else np.zeros((2, 0), np.int64)
    return np.split(out[1], np.cumsum(np.bincount(out[0], minlength=len(texts)))[:-1])


def _needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the given ids; a list of ids within the broadcast limit keeps all other texts out of the shuffle."""
    ids = materialize(ids.distinct(), "ids")
    return texts.join(small(ids, ids.count()), "id", "left_semi")


def _checked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; texts: id, text."""
    kind = pairs.schema["a"].dataType.simpleString()
    text_b = _needed(texts, pairs.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    text_a = _needed(texts, pairs.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(text_b, "b").join(text_a, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, PAIRS) for k in range(0, batch.num_rows, PAIRS)):
                leaders = part.column("text_a").to_pylist()
                place = {t: i for i, t in enumerate(dict.fromkeys(leaders))}
                sets = exact_sets([*place, *part.column("text_b").to_pylist()], width)
                keep = []
                for at, t in enumerate(leaders):
                    mine, other = sets[place[t]], sets[len(place) + at]
                    shared = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * shared >= percent * (len(mine) + len(other) - shared):
                        keep.append(at)
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            give_back()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def joining_links(sets: list[np.ndarray], parts: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets at the threshold that join the given parts, as few as join them; ``side``: only pairs of different sides count.

    Sets are held as differences from the elements that most of them share, which keeps the lists of who
    differs in an element short in a group of near copies; overlaps of differences give exact overlaps.
    """
    g = len(sets)
    sizes = np.array([len(s) for s in sets])
    element, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(g), sizes)
    usual = np.bincount(inverse, minlength=len(element)) * 2 > g
    common = np.flatnonzero(usual)
    rank = np.cumsum(usual) - 1
    has = np.zeros((g, len(common)), bool)
    inside = usual[inverse]
    has[row[inside], rank[inverse[inside]]] = True
    lack_row, lack = np.nonzero(~has)
    row, what = np.concatenate([row[~inside], lack_row]), np.concatenate([inverse[~inside], common[lack]])
    delta = np.bincount(row, minlength=g)
    shared = np.bincount(what, minlength=len(element)) > 1
    row, what = row[shared[what]], what[shared[what]]
    by_row = np.argsort(row, kind="stable")
    mine = np.split(what[by_row], np.cumsum(np.bincount(row, minlength=g))[:-1])
    by_what = np.argsort(what, kind="stable")
    holders, bound = row[by_what], np.concatenate([[0], np.cumsum(np.bincount(what, minlength=len(element)))])
    root = np.unique(parts, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in range(g - 1):
        other = root != root[i]
        other[: i + 1] = False
        if side is not None:
            other &= side != side[i]
        if not other.any():
            continue
        lists = [holders[bound[e] : bound[e + 1]] for e in mine[i].tolist()]
        both = np.bincount(np.concatenate(lists), minlength=g) if lists else np.zeros(g, np.int64)
        apart = delta + delta[i] - 2 * both
        total = sizes + sizes[i]
        linked = np.flatnonzero(other & (100 * (total - apart) >= percent * (total + apart)))
        if len(linked):
            new, first = np.unique(root[linked], return_index=True)
            out += [(i, int(j)) for j in linked[first]]
            root[np.isin(root, new)] = root[i]
    return out


def _compare_blocks(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """rows (a, lo, hi, block, id, component, text), those of a task (a, lo, hi) together: links (a, b) that join components."""

    def solve(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        group = sorted(set(group))
        lo, hi = group[0][1], group[0][2]
        sets = exact_sets([x[6] for x in group], width)
        side = None if lo == hi else np.array([x[3] == lo for x in group])
        found = joining_links(sets, np.array([x[5] for x in group]), side, percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([group[i][4] for i, _ in found], pa.int64()), pa.array([group[j][4] for _, j in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("a", "lo", "hi", "block", "id", "component", "text")), strict=True):
                if group and group[0][:3] != x[:3]:
                    yield from solve(group)
                    group = []
                group.append(x)
        if group:
            yield from solve(group)
        give_back()

    return rows.repartition("a", "lo", "hi").sortWithinPartitions("a", "lo", "hi").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: id, n_shingles, component_id, kept. Ids are integers."""
    bound_batches(docs.sparkSession)
    bands = bands_for(percent)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sketch(batch, shingle_words, bands)
            give_back()

    found = materialize(rows.mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>"), "signatures")
    linked = found.where("n > 0 AND id IS NOT NULL")
    classes = materialize(linked.groupBy("d1", "d2").agg(F.min("id").alias("leader")), "classes")
    leaders = linked.join(classes.select("d1", "d2", F.col("leader").alias("id")), ["d1", "d2", "id"], "left_semi").dropDuplicates(["id", "d1", "d2"])
    entries = leaders.select("id", F.explode("keys").alias("key"))
    least = entries.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1").select("key", "a")
    buckets = entries.join(least, "key")
    pairs = materialize(buckets.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "pairs")
    texts = rows.where("id IS NOT NULL AND text IS NOT NULL")
    links = materialize(_checked(pairs, texts, shingle_words, percent), "links")
    parts = connected_components(links)
    met = pairs.join(parts, pairs["b"] == parts["id"], "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    open_leaders = met.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("a")
    wide = materialize(met.join(open_leaders, "a"), "open")
    wide = materialize(wide.join(_needed(texts, wide.select(F.col("b").alias("id"))).withColumnRenamed("id", "b"), "b"), "open")
    sizes = wide.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    wide = wide.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    wide = wide.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = wide.select("a", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", F.col("b").alias("id"), "component", "text")
    extra = materialize(_compare_blocks(wide, shingle_words, percent), "links")
    if not extra.isEmpty():
        parts = connected_components(links.unionByName(extra))
    led = classes.join(parts.select(F.col("id").alias("leader"), "component"), "leader", "left").select("d1", "d2", F.coalesce("component", "leader").alias("component"))
    out = found.select("id", "n", "d1", "d2").join(led, ["d1", "d2"], "left")
    part = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), part.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
