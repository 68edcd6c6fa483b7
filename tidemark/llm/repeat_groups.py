"""Maximal repeat groups of a corpus, each with all its occurrences.

A group is a byte string of at least ``least`` bytes that occurs more than once, so that neither the byte before nor
the byte after is the same at all its occurrences (a border of a text differs from every byte and every border).

All occurrences of a repeat begin with the same window of ``least`` bytes, and equal windows have equal anchors at
equal offsets (``suffix_array``), so suffixes are sorted only among those that begin alike:

1. An anchor goes on if its contexts, the byte before included, are not all the same. Inside copies, where all
   occurrences extend to the left, nothing is the start of a group and nothing goes on.
2. Of its windows those go on that occur again with another byte before, which is the test of left extension.
3. The suffixes at these starts, cut off at some length, are counted per distinct string and sorted by
   (window, bytes). One stack scan over the common prefixes of neighbours visits the interval tree; an interval
   that ends before the cut and passes the test of left extension is a group.
4. A string as long as the cut that passes the test goes on with a cut four times as long, among those that share it.
   Each round's starts are one subset of the last one's, so what is read again are the texts of repeats.

A scan holds one suffix and its open intervals, not a window's members. A window that a third of all documents hold is
counted per distinct suffix before the shuffle; its distinct suffixes are streamed through one task. A round meets its
suffixes by 64-bit hashes of what they share and compares their bytes; a group's name is the SHA-256 of its bytes.

The rows are as many as the groups have occurrences: a run of one byte, n long, has a group of every length below n.

Defined results: a null text is empty; rows of equal id and text are one text; rows of equal id and other text are
texts of their own under that id; a null id stays null; other columns are ignored; a table without repeats has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize
from tidemark.llm.suffix_array import LEAST, TEXT_BYTES, _anchors, _packed, _unpacked
from tidemark.llm.textbatch import PrefixHash, bound_batches, chunks, give_back, mix, utf8

#: First cut of the suffixes, and how much longer each round's is than the one before.
FIRST_CUT = 256
GROWTH = 4
#: Bytes of suffixes in a batch, at least one suffix.
SUFFIX_BYTES = 2 << 20


def _anchor_rows(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """Every anchor with a hash of its context and the byte before, and whether the context begins its text."""
    data, offsets = utf8(batch.column("text"))
    for a, b in chunks(offsets, TEXT_BYTES):
        part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        doc, key, at, first, last = _anchors(part, inner, least)
        if not len(doc):
            continue
        base = inner[:-1][doc]
        context = PrefixHash(part).of(base + np.maximum(first - 1, 0), base + last + least) ^ mix((at - first).astype(np.uint64))
        rows = pa.array(doc + a)
        cols = [pa.array(key), pa.array(context.view(np.int64)), pa.array(first == 0), batch.column("id").take(rows), batch.column("tx").take(rows), pa.array(_packed(at, first, last, np.zeros(len(at), np.int64)))]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "context", "border", "id", "tx", "place"])


def _asked(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each row's list in ``open``, and the lists' items."""
    lists = batch.column("open")
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()


def _windows(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """key, id, tx, start, before (-1 at the border) of every window of the anchors asked for."""
    data, offsets = utf8(batch.column("text"))
    bounds, items = _asked(batch)
    place = items.to_numpy()
    for a, b in chunks(offsets, TEXT_BYTES):
        doc = np.repeat(np.arange(a, b), np.diff(bounds[a : b + 1]))
        _, first, last = _unpacked(place[bounds[a] : bounds[b]])
        n = last - first + 1
        doc = np.repeat(doc, n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        part = data[offsets[a] : offsets[b]]
        at = start + offsets[doc] - offsets[a]
        if not len(at):
            continue
        key = PrefixHash(part).of(at, at + least)
        before = np.where(start > 0, part[at - 1].astype(np.int16), -1).astype(np.int16)
        rows = pa.array(doc)
        cols = [pa.array(key.view(np.int64)), batch.column("id").take(rows), batch.column("tx").take(rows), pa.array(start.astype(np.int32)), pa.array(before)]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "tx", "start", "before"])


def _suffixes(batch: pa.RecordBatch, cut: int) -> Iterator[pa.RecordBatch]:
    """The suffixes asked for, up to ``cut`` bytes of each."""
    data, offsets = utf8(batch.column("text"))
    bounds, items = _asked(batch)
    start, key, before = items.flatten()
    doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    begin = offsets[doc] + start.to_numpy()
    end = np.minimum(begin + cut, offsets[doc + 1])
    at = 0
    written = np.append(0, np.cumsum(end - begin))
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(written, written[at] + SUFFIX_BYTES, "right")) - 1)
        taken = [data[x:y].tobytes() for x, y in zip(begin[at:to].tolist(), end[at:to].tolist(), strict=True)]
        rows, here = pa.array(doc[at:to]), slice(at, to)
        cols = [key[here], batch.column("id").take(rows), batch.column("tx").take(rows), batch.column("own").take(rows), start[here], before[here], pa.array(taken, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "tx", "own", "start", "before", "suffix"])
        at = to


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


class _Scan:
    """The stack scan over distinct suffixes in order: open intervals as [length, occurrences, least and greatest byte before]."""

    def __init__(self, least: int, cut: int):
        self.least, self.cut = least, cut
        self.open: list[list[int]] = []
        self.key, self.last = None, b""

    def close(self, to: int) -> Iterator[tuple[int, int, int, str]]:
        """Ends the intervals longer than ``to``; each one's occurrences pass to the interval around it."""
        while self.open and self.open[-1][0] > to:
            length, n, low, high = self.open.pop()
            if n > 1 and (low != high or low < 0) and length < self.cut:
                yield self.key, length, n, hashlib.sha256(self.last[:length]).hexdigest()
            if self.open and self.open[-1][0] >= to:
                around = self.open[-1]
                around[1:] = around[1] + n, min(around[2], low), max(around[3], high)
            elif to >= self.least:
                self.open.append([to, n, low, high])

    def add(self, key: int, suffix: bytes, n: int, low: int, high: int) -> Iterator[tuple[int, int, int, str]]:
        common = _common(self.last, suffix) if key == self.key else 0
        yield from self.close(common if common >= self.least else 0)
        self.key, self.last = key, suffix
        self.open.append([len(suffix), n, low, high])


def _groups(batches: Iterator[pa.RecordBatch], least: int, cut: int) -> Iterator[pa.RecordBatch]:
    scan = _Scan(least, cut)

    def out(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["key", "length", "n", "group_id"])

    for k, batch in enumerate(batches):
        cols = [batch.column(c).to_pylist() for c in ("key", "suffix", "n", "low", "high")]
        yield out([g for row in zip(*cols, strict=True) for g in scan.add(*row)])
        if k % 16 == 15:
            give_back()
    yield out(list(scan.close(0)))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, first_cut: int = FIRST_CUT) -> DataFrame:
    """One row per occurrence of each maximal repeat: group_id, length (bytes), n (occurrences of the group), id, start (byte)."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("bigint")
    rows = docs.select(own.alias("own"), F.coalesce(own, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text, own.isNull()).alias("tx"), text.alias("text"))
    rows = materialize(rows.dropDuplicates(["id", "tx"]), "texts")

    def lists(asked: DataFrame, *columns: str) -> DataFrame:
        item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
        return rows.join(asked.groupBy("id", "tx").agg(F.collect_list(item).alias("open")), ["id", "tx"])

    anchors = materialize(rows.mapInArrow(lambda bs: (x for b in bs for x in _anchor_rows(b, least)), "key bigint, context bigint, border boolean, id bigint, tx bigint, place bigint"), "anchors")
    unlike = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"), F.max("border").alias("border"))
    some = anchors.join(unlike.where("n > 1 AND (low <> high OR border)").select("key"), "key", "left_semi")
    windows = materialize(lists(some, "place").mapInArrow(lambda bs: (x for b in bs for x in _windows(b, least)), "key bigint, id bigint, tx bigint, start int, before smallint"), "windows")
    diverse = "n > 1 AND (low <> high OR low < 0)"
    lefts = (F.count("*").alias("n"), F.min("before").alias("low"), F.max("before").alias("high"))
    starts = windows.join(windows.groupBy("key").agg(*lefts).where(diverse).select("key"), "key", "left_semi")

    parts, shared, cut = [], least, max(first_cut, least + 1)
    while True:
        taken = lists(starts, "start", "key", "before").mapInArrow(lambda bs, cut=cut: (x for b in bs for x in _suffixes(b, cut)), "key bigint, id bigint, tx bigint, own bigint, start int, before smallint, suffix binary")
        suffixes = materialize(taken.withColumn("whole", F.sha2("suffix", 256)), "suffixes")
        classes = materialize(suffixes.groupBy("key", "whole").agg(F.first("suffix").alias("suffix"), *lefts), "classes")
        ordered = classes.repartition("key").sortWithinPartitions("key", "suffix")
        found = materialize(ordered.mapInArrow(lambda bs, shared=shared, cut=cut: _groups(bs, shared, cut), "key bigint, length int, n bigint, group_id string"), "groups")
        # an occurrence is in a group if its suffix begins with the group's bytes
        lengths = found.groupBy("key").agg(F.collect_set("length").alias("lengths"))
        each = suffixes.join(lengths, "key").withColumn("length", F.explode("lengths")).where("octet_length(suffix) >= length")
        named = each.withColumn("group_id", F.expr("sha2(substring(suffix, 1, length), 256)"))
        parts.append(named.join(found.select("group_id", "length", "n"), ["group_id", "length"]).select("group_id", "length", "n", F.col("own").alias(id_col), "start"))
        longer = classes.where(diverse).where(F.octet_length("suffix") == cut).select("key", "whole")
        starts = materialize(suffixes.join(longer, ["key", "whole"], "left_semi").select("id", "tx", "start", F.xxhash64("whole").alias("key"), "before"), "starts")
        if starts.isEmpty():
            break
        shared, cut = cut, cut * GROWTH
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
