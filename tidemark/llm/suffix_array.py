"""Repeated byte strings by enhanced suffix arrays and their common-prefix interval trees.

``enhanced`` sorts suffixes and measures neighbours' common prefixes on their bytes; a stack scan over these
(``intervals``) visits every interval of the tree, and those whose occurrences differ in the byte before
them are the maximal repeats (``maximal_repeats``), each with all its occurrences. Nothing is removed but
by such an interval.

For a corpus, suffixes of all texts cannot be sorted in one place. Which of them meet is chosen by content:
of every ``least``-byte window the least hashed ``ANCHOR``-gram (leftmost of equals) is its anchor, so equal
windows have equal anchors at equal offsets. Hashes say no more than where to meet.

1. Anchors are dealt out by their hash; those whose hash occurs again go on.
2. The context of such an anchor (all windows that it is the anchor of, at most 168 bytes) is cut from its text
   and sorted among those of the same anchor: a suffix array of the corpus, sparse but whole in every
   window. Equal neighbours form the leaves of its tree. The first of each leaf stands for it from there on;
   the suffixes of these, at every window, form a second array whose intervals hold what unequal contexts share.
3. An anchor with more than ``KEY_BYTES`` of distinct contexts is not held in one task: its contexts are cut into
   slices of fewer window starts (``SPANS``), which meet under the bytes that all windows of a slice share, and
   at last into single windows, where only equal ones meet. Tasks stream over sorted rows at every level.
4. Marked ranges are merged per document.

Equal contexts within one batch of texts are brought together before the shuffle, so a passage that a third of
all documents hold sends one row per batch.

Order is by document id, then start; rows of equal id are ordered by a 64-bit hash of their text. Ids are integers
(a text that is no number fails). Defined results: a null text is empty; nulls of id come first, as the least id
does; repeated rows count as copies of one document, of which each is marked against earlier documents only, not
against one another; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize
from tidemark.llm.textbatch import PrefixHash, bound_batches, chunks, give_back, mix, utf8

LEAST = 100
ANCHOR = 32
#: Window starts of a slice, as parts of a context; each level is for anchors too frequent for the one before.
PARTS = (1, 3)
#: Bytes of distinct contexts of one anchor that a task holds.
KEY_BYTES = 1 << 20
#: Bytes of distinct contexts whose suffixes are sorted at a time (those of one anchor stay together).
TREE_BYTES = 512 << 10
#: Text bytes whose anchors are worked out at a time.
TEXT_BYTES = 512 << 10


def enhanced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end] by their first ``depth`` bytes, and each one's common prefix with the one before (0 for the first)."""
    n = len(starts)
    room = np.minimum(ends - starts, depth)
    # numpy takes trailing zero bytes for none; of strings that differ in those alone the shorter comes first
    order = np.argsort(room, kind="stable")
    room = room[order]
    rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(depth, np.uint8)), depth)[starts[order]]
    if (room < depth).any():
        rows[np.arange(depth)[None, :] >= room[:, None]] = 0
    again = np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")
    order, rows, room = order[again], rows[again], room[again]
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        common[1:] = np.minimum(first, np.minimum(room[1:], room[:-1]))
    return order, common


def intervals(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, lo and hi: intervals [lo, hi) of suffixes with a common prefix of ``length`` >= ``least`` that no wider interval shares."""
    deep = np.flatnonzero(common >= least)
    if not len(deep):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    value = common[deep]
    new = np.ones(len(deep), bool)
    new[1:] = np.diff(deep) > 1
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(deep))
    flat = np.minimum.reduceat(value, at) == np.maximum.reduceat(value, at)
    # a run of one value is one interval
    out = [(value[at[flat]], deep[at[flat]] - 1, deep[end[flat] - 1] + 1)]
    rest: list[tuple[int, int, int]] = []
    for s, e in zip(at[~flat].tolist(), end[~flat].tolist(), strict=True):
        stack: list[tuple[int, int]] = []
        for i, c in zip(deep[s:e].tolist(), value[s:e].tolist(), strict=True):
            lo = i - 1
            while stack and stack[-1][0] > c:
                length, lo = stack.pop()
                rest.append((length, lo, i))
            if not stack or stack[-1][0] < c:
                stack.append((c, lo))
        while stack:
            length, lo = stack.pop()
            rest.append((length, lo, int(deep[e - 1]) + 1))
    if rest:
        out.append(tuple(np.array(x, np.int64) for x in zip(*rest, strict=True)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def maximal_repeats(order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the repeats that no byte to either side extends, the bounds of each one's occurrences, and the occurrences.

    ``before``: the byte left of each suffix, -1 at a border, which differs from all others.
    """
    length, lo, hi = intervals(common, least)
    left = before[order]
    change = np.zeros(len(order) + 1, np.int64)
    change[2:] = np.cumsum(left[1:] != left[:-1])
    border = np.concatenate([[0], np.cumsum(left < 0)])
    diverse = (change[hi] > change[lo + 1]) | (border[hi] > border[lo])
    length, lo, hi = length[diverse], lo[diverse], hi[diverse]
    bounds = np.concatenate([[0], np.cumsum(hi - lo)])
    return length, bounds, order[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - lo, hi - lo)]


def _later(length: np.ndarray, bounds: np.ndarray, found: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the repeats' occurrences, all but the earliest of each, with the repeat's length."""
    if not len(found):
        return found, found
    r = rank[found]
    n = np.diff(bounds)
    rest = r != np.repeat(np.minimum.reduceat(r, bounds[:-1]), n)
    return found[rest], np.repeat(length, n)[rest]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of the keys (the first is the primary one); equal ones share a place."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Document, hash, place, first and last window start of every run of windows with one anchor; places relative to the document."""
    width = least - ANCHOR + 1
    n = len(data)
    if n < least:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = PrefixHash(data)
    grams = prefix.of(np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1))
    # high bits of the hash, then the place: the least of a window is its leftmost least gram
    place = np.uint64((1 << max(22, n.bit_length())) - 1)
    low = _window_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), width)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(n - least + 1) + least <= ends[: n - least + 1])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    leftmost = (low[start] & place).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (leftmost[1:] != leftmost[:-1]) | (start[1:] != start[:-1] + 1)
    first = start[new]
    last = start[np.append(new[1:], True)]
    at = leftmost[new]
    doc = np.searchsorted(offsets, first, "right") - 1
    base = offsets[:-1][doc]
    return doc, grams[at].view(np.int64), at - base, first - base, last - base


def _packed(at: np.ndarray, first: np.ndarray, last: np.ndarray, known: np.ndarray) -> np.ndarray:
    """An anchor's place, how far before it its windows start, and whether it is known to occur again, in one number."""
    return ((at << 12 | at - first) << 12 | at - last) << 1 | known


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 25
    return at, at - (place >> 13 & 0xFFF), at - (place >> 1 & 0xFFF)


def _anchor_rows(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """key, id, tx, place of every anchor. Of those that share a hash in this batch one stands for all; the others are known to occur again and dealt out evenly."""
    data, offsets = utf8(batch.column("text"))
    found = []
    for a, b in chunks(offsets, TEXT_BYTES):
        doc, *rest = _anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)
        found.append((doc + a, *rest))
    doc, key, at, first, last = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    known, follows = np.zeros(len(order), bool), np.zeros(len(order), bool)
    known[order], follows[order] = same[1:] | same[:-1], same[:-1]
    rows = pa.array(doc)
    place = _packed(at, first, last, known)
    dealt = mix(key.view(np.uint64) ^ mix(place.view(np.uint64) + doc.astype(np.uint64))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.where(follows, dealt, key)), batch.column("id").take(rows), batch.column("tx").take(rows), pa.array(place)], names=["key", "id", "tx", "place"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those that share it with another or are known to."""
    names = ["id", "tx", "place"]
    held, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        same = np.ones(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[0] = last is not None and last == key[0]
        if held is not None and same[0]:
            yield held
        go_on = same | (batch.column("place").to_numpy() & 1 == 1)
        go_on[:-1] |= same[1:]
        held = None if go_on[-1] else batch.slice(len(key) - 1, 1).select(names)
        last = key[-1]
        yield batch.filter(pa.array(go_on)).select(names)


_ROW = "key bigint, bytes binary, id bigint, tx bigint, start int, at int, done boolean"
_FOUND = "id bigint, tx bigint, start int, at int, bytes binary"


def _rows(key: np.ndarray, data: list[bytes], ids: np.ndarray, tx: np.ndarray, start: np.ndarray, at: np.ndarray, done: bool) -> pa.RecordBatch:
    cols = [pa.array(key), pa.array(data, pa.binary()), pa.array(ids), pa.array(tx), pa.array(start.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array([done] * len(key), pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, names=["key", "bytes", "id", "tx", "start", "at", "done"])


def _found(ids: np.ndarray, tx: np.ndarray, start: np.ndarray, at: np.ndarray, data: list | None = None) -> pa.RecordBatch:
    """Marked ranges [start, at) of documents, or, with bytes, contexts for the next level."""
    cols = [pa.array(ids), pa.array(tx), pa.array(start.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(data if data is not None else [None] * len(ids), pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "tx", "start", "at", "bytes"])


def _slices(data: np.ndarray, base: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, span: int) -> tuple[np.ndarray, ...]:
    """Row, key, context hash, first and last window start of the slices of ``span`` window starts, counted from the anchor so that equal windows fall into equal slices."""
    lo_k, hi_k = (at - last) // span, (at - first) // span
    n = hi_k - lo_k + 1
    row = np.repeat(np.arange(len(at)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo_k, n)
    at, first, last, base = at[row], first[row], last[row], base[row]
    lo, hi = np.maximum(first, at - (k + 1) * span + 1), np.minimum(last, at - k * span)
    prefix = PrefixHash(data)
    key = prefix.of(at - k * span + base, at - (k + 1) * span + 1 + least + base)
    context = prefix.of(lo + base, hi + least + base) ^ mix((at - lo).astype(np.uint64))
    return row, key.view(np.int64), context, lo, hi


def _combined(key: np.ndarray, context: np.ndarray, data: list[bytes], ids: np.ndarray, tx: np.ndarray, start: np.ndarray, at: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Rows for the shuffle; of equal contexts the earliest alone goes on and the others are marked."""
    order = np.lexsort((start, tx, ids, context, key))
    alike = np.zeros(len(order), bool)
    alike[1:] = (key[order][1:] == key[order][:-1]) & (context[order][1:] == context[order][:-1])
    common = np.zeros(len(order), np.int64)
    for i in np.flatnonzero(alike).tolist():
        mine = data[order[i]]
        common[i] = len(mine) if mine == data[order[i - 1]] else 0
    go_on = np.empty(len(order), bool)
    go_on[order] = common == 0
    later, length = _later(*maximal_repeats(order, common, np.full(len(order), -1), least), _ranks(ids, tx, start))
    keep = np.flatnonzero(go_on)
    if len(keep):
        yield _rows(key[keep], [data[i] for i in keep.tolist()], ids[keep], tx[keep], start[keep], at[keep], False)
    if len(later):
        # marks are dealt out evenly
        yield _rows(mix(key[later].view(np.uint64) ^ mix(ids[later].view(np.uint64) + start[later].astype(np.uint64))).view(np.int64), [b""] * len(later), ids[later], tx[later], start[later], start[later] + length, True)


def _contexts(batch: pa.RecordBatch, least: int, span: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors that go on, cut from their texts."""
    data, offsets = utf8(batch.column("text"))
    asked = batch.column("open")
    bounds = asked.offsets.to_numpy() - asked.offsets[0].as_py()
    place = asked.flatten().to_numpy()
    own_id, own_tx = batch.column("id").to_numpy(), batch.column("tx").to_numpy()
    parts = []
    for a, b in chunks(offsets, TEXT_BYTES):
        row = np.repeat(np.arange(a, b), np.diff(bounds[a : b + 1]))
        mine = place[bounds[a] : bounds[b]]
        once = np.lexsort((mine, row))
        new = np.ones(len(once), bool)  # repeated rows ask twice for the same
        new[1:] = (mine[once][1:] != mine[once][:-1]) | (row[once][1:] != row[once][:-1])
        row, mine = row[once][new], mine[once][new]
        if not len(row):
            continue
        at, first, last = _unpacked(mine)
        part = data[offsets[a] : offsets[b]]
        base = offsets[row] - offsets[a]
        of, key, context, lo, hi = _slices(part, base, at, first, last, least, span)
        raw = part.tobytes()
        taken = [raw[x:y] for x, y in zip((lo + base[of]).tolist(), (hi + base[of] + least).tolist(), strict=True)]
        parts.append((key, context, taken, own_id[row[of]], own_tx[row[of]], lo, at[of] - lo))
    if parts:
        key, context, taken, ids, tx, lo, at = zip(*parts, strict=True)
        yield from _combined(np.concatenate(key), np.concatenate(context), [x for t in taken for x in t], *(np.concatenate(x) for x in (ids, tx, lo, at)), least)


def _finer(batch: pa.RecordBatch, least: int, span: int) -> Iterator[pa.RecordBatch]:
    """Contexts that were too many under their key, cut into slices of fewer window starts."""
    data, offsets = utf8(batch.column("bytes"))
    if not batch.num_rows:
        return
    ids, tx, start, at = (batch.column(c).to_numpy() for c in ("id", "tx", "start", "at"))
    sizes = np.diff(offsets)
    at = at.astype(np.int64)
    of, key, context, lo, hi = _slices(data, offsets[:-1], at, np.zeros(len(at), np.int64), sizes - least, least, span)
    raw = data.tobytes()
    base = offsets[:-1][of]
    taken = [raw[x:y] for x, y in zip((lo + base).tolist(), (hi + base + least).tolist(), strict=True)]
    yield from _combined(key, context, taken, ids[of], tx[of], start[of] + lo, at[of] - lo, least)


class _Contexts:
    """Rows (key, id, tx, start, at, bytes) in arrays."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, tx: np.ndarray, start: np.ndarray, at: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.cols, self.sizes, self.data = (key, ids, tx, start, at), sizes, data
        self.ends = np.cumsum(sizes)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Contexts:
        data, offsets = utf8(batch.column("bytes"))
        key, ids, tx, start, at = (batch.column(c).to_numpy() for c in ("key", "id", "tx", "start", "at"))
        return cls(key, ids, tx, start.astype(np.int64), at.astype(np.int64), np.diff(offsets), data)

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, keep: np.ndarray) -> _Contexts:
        return _Contexts(*(c[keep] for c in self.cols), self.sizes[keep], self.data[np.repeat(keep, self.sizes)])

    def cut(self, a: int, b: int) -> _Contexts:
        begin = self.ends[a] - self.sizes[a] if a < len(self) else 0
        return _Contexts(*(c[a:b] for c in self.cols), self.sizes[a:b], self.data[begin : self.ends[b - 1] if b > a else begin])

    def after(self, other: _Contexts | None) -> _Contexts:
        if other is None or not len(other):
            return self
        return _Contexts(*(np.concatenate(x) for x in zip(other.cols, self.cols, strict=True)), np.concatenate([other.sizes, self.sizes]), np.concatenate([other.data, self.data]))

    def raw(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[e - n : e] for e, n in zip(self.ends.tolist(), self.sizes.tolist(), strict=True)]


def _leaves(rows: _Contexts) -> np.ndarray:
    """Of sorted rows, each one's common prefix with the one before if all of both, else 0: equal contexts are the leaves of the tree."""
    key = rows.cols[0]
    common = np.zeros(len(rows), np.int64)
    maybe = np.flatnonzero((key[1:] == key[:-1]) & (rows.sizes[1:] == rows.sizes[:-1])) + 1
    if len(maybe):
        # neighbours of one size lie one size apart, so that comparing all bytes with those so far back settles all pairs
        n = rows.sizes[maybe]
        bounds = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(rows.ends[maybe] - n - bounds, n)
        equal = np.logical_and.reduceat(rows.data[at] == rows.data[at - np.repeat(n, n)], bounds)
        common[maybe[equal]] = n[equal]
    return common


def _shared(rows: _Contexts, least: int) -> pa.RecordBatch | None:
    """Ranges that distinct contexts share with earlier ones: each range holds the anchor, so those of one context are one."""
    _, ids, tx, start, _ = rows.cols
    windows = rows.sizes - least + 1
    begin = rows.ends - rows.sizes
    row = np.repeat(np.arange(len(rows)), windows)
    off = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[row] + off
    # a window that occurs once is in no repeat
    seen = PrefixHash(rows.data).of(at, at + least)
    order = np.argsort(seen)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = seen[order][1:] == seen[order][:-1]
    pick = np.sort(order[same[1:] | same[:-1]])
    if not len(pick):
        return None
    row, off, at = row[pick], off[pick], at[pick]
    before = np.where(off > 0, rows.data[at - 1].astype(np.int64), -1)
    sorted_, common = enhanced(rows.data, at, rows.ends[row], int(rows.sizes.max()))
    later, length = _later(*maximal_repeats(sorted_, common, before, least), _ranks(ids[row], tx[row], start[row] + off))
    if not len(later):
        return None
    lo, hi = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
    np.minimum.at(lo, row[later], off[later])
    np.maximum.at(hi, row[later], off[later] + length)
    some = np.flatnonzero(hi)
    return _found(ids[some], tx[some], start[some] + lo[some], start[some] + hi[some])


def _trees(rows: _Contexts, least: int) -> Iterator[pa.RecordBatch]:
    """``_shared`` over the keys that have more than one context, some keys at a time."""
    key = rows.cols[0]
    if not len(key):
        return
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    rows = rows.take(same[1:] | same[:-1])
    if not len(rows):
        return
    key = rows.cols[0]
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    a, size = 0, 0
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        n = int(rows.sizes[x:y].sum())
        if size and size + n > TREE_BYTES:
            if (got := _shared(rows.cut(a, x), least)) is not None:
                yield got
            a, size = x, 0
        size += n
    if (got := _shared(rows.cut(a, len(key)), least)) is not None:
        yield got


def _repeats(batches: Iterator[pa.RecordBatch], least: int, key_bytes: int = KEY_BYTES) -> Iterator[pa.RecordBatch]:
    """Marked ranges from contexts sorted by key, bytes and place; contexts of a key with too many of them are returned for the next level."""
    held: _Contexts | None = None
    overflowed = None
    for batch in batches:
        if not batch.num_rows:
            continue
        done = batch.column("done").to_numpy(zero_copy_only=False)
        if done.any():
            settled = batch.filter(pa.array(done))
            yield _found(*(settled.column(c).to_numpy() for c in ("id", "tx", "start", "at")))
            batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
        rows = _Contexts.of(batch).after(held)
        n_held = 0 if held is None else len(held)
        _, ids, tx, start, _ = rows.cols
        common = _leaves(rows)
        order = np.arange(len(rows))
        later, length = _later(*maximal_repeats(order, common, np.full(len(rows), -1), least), _ranks(ids, tx, start))
        if len(later):
            yield _found(ids[later], tx[later], start[later], start[later] + length)
        distinct = common == 0
        fresh = distinct.copy()
        fresh[:n_held] = False
        kept = rows.take(distinct)
        key = kept.cols[0]
        if overflowed is not None:
            # the held row of that key went on before
            again = fresh[distinct] & (key == overflowed)
            if again.any():
                more = kept.take(again)
                yield _found(*more.cols[1:], more.raw())
            rest = key != overflowed
            if not rest.any():
                held = kept.cut(len(kept) - 1, len(kept))
                continue
            kept, overflowed = kept.take(rest), None
            key = kept.cols[0]
        others = np.flatnonzero(key != key[-1])
        open_from = int(others[-1]) + 1 if len(others) else 0
        yield from _trees(kept.cut(0, open_from), least)
        held = kept.cut(open_from, len(kept))
        if int(held.sizes.sum()) > key_bytes:
            yield _found(*held.cols[1:], held.raw())
            overflowed, held = key[-1], held.cut(len(held) - 1, len(held))
    if held is not None and overflowed is None:
        yield from _trees(held, least)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = utf8(batch.column("text"))
    marks = batch.column("marks").to_pylist()
    rows = []
    for i, found in enumerate(marks):
        raw = data[offsets[i] : offsets[i + 1]]
        if found:
            step = np.zeros(len(raw) + 1, np.int64)
            np.add.at(step, [m["a"] for m in found], 1)
            np.add.at(step, [m["b"] for m in found], -1)
            gone = np.cumsum(step[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = raw[~gone].tobytes()
        else:
            spans, kept = 0, raw.tobytes()
        rows.append((len(raw), len(raw) - len(kept), spans, kept))
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    hashes = [hashlib.sha256(k).hexdigest() for k in cols[3]]
    yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(hashes, pa.string()), pa.array(cols[3], pa.binary())], names=["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; what Arrow holds but no longer uses goes back to the system now and then."""
    for k, batch in enumerate(batches):
        yield batch
        if k % 16 == 15:
            give_back()


def repeated_ranges(rows: DataFrame, least: int = LEAST, key_bytes: int = KEY_BYTES) -> DataFrame:
    """rows (id, tx, text), no nulls, to (id, tx, a, b): byte ranges covered by a ``least``-byte string that also starts earlier."""
    bound_batches(rows.sparkSession)
    width = least - ANCHOR + 1
    spans = [*(-(-width // p) for p in PARTS), 1]

    def meet(contexts: DataFrame) -> DataFrame:
        ordered = contexts.repartition("key").sortWithinPartitions("key", "bytes", "id", "tx", "start")
        return materialize(ordered.mapInArrow(lambda bs: _released(_repeats(bs, least, key_bytes)), _FOUND), "repeats")

    anchors = rows.mapInArrow(lambda bs: _released(_anchor_rows(b, least) for b in bs), "key bigint, id bigint, tx bigint, place bigint")
    met = anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "id bigint, tx bigint, place bigint")
    # written once, so that the anchors' shuffle can be dropped before texts and contexts need room
    asked = materialize(met, "anchors").groupBy("id", "tx").agg(F.collect_list("place").alias("open"))
    cut = rows.join(asked, ["id", "tx"]).select("id", "tx", "text", "open").mapInArrow(lambda bs: _released(x for b in bs for x in _contexts(b, least, spans[0])), _ROW)
    found = meet(cut)
    marks = found.where("bytes IS NULL")
    for span in spans[1:]:
        crowded = found.where("bytes IS NOT NULL")
        if crowded.isEmpty():
            break
        found = meet(crowded.mapInArrow(lambda bs, span=span: _released(x for b in bs for x in _finer(b, least, span)), _ROW))
        marks = marks.unionByName(found.where("bytes IS NULL"))
    return marks.select("id", "tx", F.col("start").alias("a"), F.col("at").alias("b"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, with_kept: bool = True) -> DataFrame:
    """Per document row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("bigint")
    rows = docs.select(own.alias("own"), F.coalesce(own, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text, own.isNull()).alias("tx"), text.alias("text"))
    marks = repeated_ranges(rows.select("id", "tx", "text"), least).groupBy("id", "tx").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    out = rows.join(marks, ["id", "tx"], "left").select("own", "text", "marks")
    done = out.mapInArrow(lambda bs: (x for b in bs for x in _cut(b)), "own bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return done.select(F.col("own").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else []))
