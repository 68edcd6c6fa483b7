"""Maximal repeat groups against a brute-force version that looks every candidate up in every text."""

import os
import random

import pytest

from tidemark.llm import repeat_groups

SCHEMA = "doc_id bigint, text string"


def brute(texts: dict, least: int) -> dict:
    """Group -> occurrences: common prefixes of neighbours among all suffixes, kept if no byte to the left extends them."""
    every = sorted((t[i:], k, i) for k, t in texts.items() for i in range(len(t) - least + 1))
    candidates = {os.path.commonprefix([a[0], b[0]]) for a, b in zip(every, every[1:])}
    out = {}
    for c in candidates:
        if len(c) < least:
            continue
        places, left = [], set()
        for k, t in texts.items():
            i = t.find(c)
            while i >= 0:
                places.append((k, i))
                left.add(t[i - 1] if i else ("border", k))
                i = t.find(c, i + 1)
        if len(left) > 1 or (len(places) > 1 and any(isinstance(x, tuple) for x in left)):
            out[c] = sorted(places)
    return out


def groups(df, least, **more):
    got = {}
    for r in repeat_groups.repeat_groups(df, least=least, **more).collect():
        got.setdefault((r.group_id, r.length, r.n), []).append((r.doc_id, r.start))
    return got


def check(spark, texts, least, **more):
    import hashlib

    df = spark.createDataFrame([(k, t) for k, t in texts.items()], SCHEMA).repartition(3)
    want = brute({k: t.encode() for k, t in texts.items() if t}, least)
    got = groups(df, least, **more)
    assert {k: sorted(v) for k, v in got.items()} == {(hashlib.sha256(c).hexdigest(), len(c), len(p)): p for c, p in want.items()}
    return want


@pytest.mark.parametrize("seed", range(3))
def test_groups_are_all_maximal_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé c") for _ in range(n))
    long, short, tail = word(900), word(130), word(60)
    texts = {
        1: word(50) + long + word(30) + short,
        2: long + word(10) + short + tail,
        3: word(5) + short + tail + short + tail,  # repeats in itself
        4: long[:400] + word(40) + long[300:],  # leaves a copy and comes back to it
        5: word(200),
        6: word(5) + long,  # another end
        7: "",
        8: None,
        9: "xy" * 120,  # overlaps itself
        10: "q" + long + short + "z",
    }
    want = check(spark, texts, 100)
    assert max(map(len, want)) > 900
    check(spark, texts, 100, first_cut=101)


def test_exact_copies_are_one_group(spark):
    t = "".join(random.Random(5).choices("abcdefgh ", k=1500))
    want = check(spark, {k: t for k in range(40)}, 100)
    assert [(len(c), len(p)) for c, p in want.items()] == [(1500, 40)]


def test_repeated_rows_nulls_clashes_and_empty_tables(spark):
    t = "".join(random.Random(6).choices("abcdefgh ", k=300))
    cols = "doc_id bigint, text string, key bigint, suffix string, n int"
    df = spark.createDataFrame([(1, t, 1, "s", 1), (1, t, 2, None, 2), (None, "x" + t, 1, "s", 1), (2, None, 0, None, 0), (2, "", 0, None, 0)], cols)
    got = groups(df, 100)
    assert [(k[1], k[2], sorted(v, key=str)) for k, v in got.items()] == [(300, 2, [(1, 0), (None, 1)])]
    assert groups(df.limit(0), 100) == {}
    assert groups(df.where("doc_id = 1"), 100) == {}


def test_a_scan_holds_no_members():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    core = b"c" * 100

    def batches():
        for k in range(60):
            tails = sorted(bytes([k]) + rng.bytes(100) for _ in range(2000))
            cols = [pa.array([7] * 2000), pa.array([core + x for x in tails], pa.binary()), pa.array([1] * 2000), pa.array([1] * 2000), pa.array([2] * 2000)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "suffix", "n", "low", "high"])

    tracemalloc.start()
    found = [r for b in repeat_groups._groups(batches(), 100, 256) for r in b.to_pylist() if r["length"] == 100]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["n"] for r in found] == [120_000]
    assert peak < 40 << 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_groups_cover_what_is_removed(spark):
    """All occurrences of each group but the earliest are together the bytes that ``remove_repeats`` takes."""
    from tidemark.llm import suffix_array

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    gone, seen = {}, set()
    for r in sorted(repeat_groups.repeat_groups(docs).collect(), key=lambda r: (r.group_id, r.doc_id, r.start)):
        if r.group_id in seen:
            gone.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
        seen.add(r.group_id)
    removed = {r.doc_id: r.n_removed for r in suffix_array.remove_repeats(docs).where("n_removed > 0").collect()}
    assert {k: len(v) for k, v in gone.items()} == removed
