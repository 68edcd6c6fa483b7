"""The corpus operators against plain versions, on planted cases and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import bpe, decontamination, fingerprints, graph, html_blocks, minhash, reputation, secrets, suffix_array, textbatch, toxicity, warc
from tidemark.llm.storage import fresh_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed=1, n=60):
    """Plain, copied, edited, empty, null and very long texts, with shared passages, secrets and repeated rows' ids."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = []
    for i in range(n):
        k = i % 10
        base = words(rng, rng.randint(1, 120))
        if k == 3:
            base = texts[rng.randrange(len(texts))] or base
        elif k == 4:
            base = base + " " + passage + "\n" + words(rng, 5)
        elif k == 5 and texts[i - 5]:
            w = texts[i - 5].split()
            w[len(w) // 2] = "changed"
            base = " ".join(w)
        elif k == 6:
            base = f'Api_Key = "{"Abc123" * 2}" ééé AKIA{"Z9" * 9} token: abc password: token: abcdefgh {"0af9" * 7}'
        texts.append(base)
    texts += ["", None, "   ", "x", words(rng, 9000), "ab " * 400]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
    # extra columns whose names operators use themselves
    return df.select("*", *(F.lit("clash").alias(c) for c in ("id", "n", "key", "words", "spans", "tx", "score", "marks"))).repartition(5).cache()


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_decontamination(spark, docs, rows):
    texts = dict(rows)
    long = texts[4].split()
    items = [(0, " ".join(long[-40:-20])), (1, "x"), (2, ""), (3, None), (10, " ".join(long[-30:])), (0, " ".join(long[-40:-20])), (7, "no such words here " * 4)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert len(got) == len(rows)
    hits = 0
    for d, n, h, ids in brute.decontamination(rows, items):
        r = got[d]
        assert (r.n_words, len(r.positions), list(r.item_ids), r.contaminated) == (n, h, ids, h > 0)
        hits += h > 0
    assert hits >= 6


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x b y c"), (2, "a b c"), (3, "c b a")], "doc_id bigint, text string")
    items = decontamination.items_of(spark.createDataFrame([(5, "a b c")], "item_id bigint, text string"))
    index = decontamination.build_index(d, items)
    near = lambda slop: sorted(r.id for r in decontamination.proximity_matches(index, items, slop).collect())
    assert near(0) == [2] and near(2) == [1, 2]


def test_proximity_gives_every_start(spark):
    d = spark.createDataFrame([(1, "a b c z z z a x b y c"), (None, "a b c"), (3, "a b")], "doc_id bigint, text string")
    items = decontamination.items_of(spark.createDataFrame([(5, "a b c"), (6, "c")], "item_id bigint, text string"))
    index = decontamination.build_index(d, items)
    near = sorted((r.id or 0, r.item_id, r.start) for r in decontamination.proximity_matches(index, items, 2).collect())
    assert near == [(0, "5", 0), (0, "6", 2), (1, "5", 0), (1, "5", 6), (1, "6", 2), (1, "6", 10)]


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, words(rng, 30) + (" vile wretch " if bad else " ") + words(rng, 10)))
        labels.append((i, int(bad)))
    rows += [(600, None), (601, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit(9))
    model = toxicity.train(d, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id bigint, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert got[600] == got[601] < 0.5 and len(model[0]) < 2000
    mark = {r.doc_id: r.h for r in d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(mark[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in mark)
    none = toxicity.train(d, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(d, none).where("score >= 0.5").count() == 0


def test_html(spark):
    page = '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now cheap.</div><article><h1>Head &amp; line</h1><p>First   part\nof it.</p><p><b>Second.<br><p>Third &eacute;.</article><div class="comments"><p>Reader says no.</p></div><footer>&copy; us</footer></body></html>'
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (4, "w", "<p>" * 3000 + "x")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_blocks.extract(d).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].text == "Head & line\n\nFirst part of it.\n\nSecond.\n\nThird é." and by[2].text == by[3].text == ""


def test_html_keeps_text_beside_embedded_elements():
    texts = lambda page: [b.text for b in html_blocks.leaf_blocks(page)]
    assert texts('<p>One.</p><svg class="icon"/><p>Two.</p>') == ["One.", "Two."]
    assert texts("<p>One.</p><math/><p>Two.</p>") == ["One.", "Two."]
    for name in ("svg", "template", "canvas", "audio", "video", "iframe"):
        assert texts(f"<p>One.</p><{name} id=a><p>Two.</p>") == ["One.", "Two."]
        assert texts(f"<p>One.</p><{name} id=a>no</{name.upper()} ><p>Two.</p>") == ["One.", "Two."]
    for name in ("script", "style"):
        assert texts(f"<p>One.</p><{name}>var a = '<p>no</p>'") == ["One."]
        assert texts(f"<p>One.</p><{name}>no</{name}><p>Two.</p>") == ["One.", "Two."]
    assert texts("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>") == ["So x=2 holds."]
    assert texts("<noscript><p>One.</p></noscript><object><p>Two.</p></object>") == ["One.", "Two."]
    assert texts("<p>a</p>" + "<video>" * 20_000 + "<p>b</p>") == ["a", "b"]


def test_html_blocks_against_a_plain_reader(spark):
    import os

    pages = ["<p>one <a title=\"x>two</p>", "a < b <3 & c", "<P CLASS=Big id='x y'>t</P>", "<li>a<li>b<ul><li>c</ul>d", "<td>a<td>b<tr><td>c", "x<!-- no -->y<!-- open", "<p title=it's>z"]
    if os.path.isdir("/root/testdata/sf0.001"):
        pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.html]
    draw = html_blocks._Layouts(55)
    pages += [draw.page().translate({1: None, 2: None}) for _ in range(60)]
    for page in pages:
        assert [b.text for b in html_blocks.leaf_blocks(page)] == brute.block_texts(page), page


def test_html_reading_is_linear():
    import time

    for page in ("<a " * 350_000, '<a title="x>' * 80_000, "<a b='" * 170_000, "<!--" * 250_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<p " + "class " * 160_000 + ">x", "<script>" * 120_000):
        began = time.process_time()
        html_blocks.leaf_blocks(page)
        assert time.process_time() - began < 8, page[:20]


def test_html_model_is_kept(spark, monkeypatch):
    monkeypatch.setattr(html_blocks, "_ready", [])
    first = html_blocks.kept_model(spark)
    monkeypatch.setattr(html_blocks, "_ready", [])
    monkeypatch.setattr(html_blocks, "trained", lambda: 1 / 0)
    again = html_blocks.kept_model(spark)
    assert all((first.p[k] == again.p[k]).all() for k in first.p)


def test_html_held_out_layouts():
    model, draw = html_blocks.trained(), html_blocks._Layouts(987)
    right = total = 0
    for _ in range(150):
        x, y = html_blocks._labelled(draw.page())
        a, mask, _ = html_blocks.padded([x])
        right += int(((model.forward(a, mask)[0][0] > 0) == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.95


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    m = html_blocks.BiLstm(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask, y = rng.standard_normal((2, 4, html_blocks.INPUT_DIM)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]]), np.array([[1, 0, 1, 0], [0, 1, 0, 0.0]])

    def loss():
        s = 1 / (1 + np.exp(-m.forward(x, mask)[0]))
        return -((y * np.log(s) + (1 - y) * np.log(1 - s)) * mask).sum() / mask.sum()

    g = m.gradients(x, mask, y)
    for k in ("xf", "hb", "cf", "o"):
        at = tuple(rng.integers(0, n) for n in m.p[k].shape)
        keep = m.p[k][at]
        m.p[k][at] = keep + 1e-3
        up = loss()
        m.p[k][at] = keep - 1e-3
        down = loss()
        m.p[k][at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3


def test_warc(spark):
    pages = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/3", None), (4, "u", ""), (5, "u\r\nx: y", "é" * 9000), (None, "n", "same"), (7, "u", "same"), (7, "u", "same")]
    pages += [(100 + i, f"http://h/{i}", f"<html><p>page {i} of a common layout</p></html>" * 20) for i in range(60)]
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    manifest = warc.write_archives(d, fresh_path(spark, "arc"), archive_bytes=20_000)
    assert manifest.count() > 3
    got = warc.read_archives(manifest).collect()
    assert sorted((r.page_id is None, r.page_id, bytes(r.payload)) for r in got if r.record_type == "response") == sorted((False, i, (h or "").encode()) for i, _, h in pages if i not in (None, 2, 4, 7))
    again = sorted((r.page_id or -1, r.refers_to, r.payload_bytes) for r in got if r.record_type == "revisit")
    assert again == [(-1, 1, 4), (2, 1, 4), (4, 3, 0), (7, 1, 4), (7, 1, 4)]
    assert all(r.payload_digest == warc.digest_of(b"same") for r in got if r.refers_to == 1)
    assert {r.page_id: r.url for r in got if r.page_id in (2, 5)} == {2: None, 5: "u x: y"}
    assert warc.read_archives(manifest, tasks=4).rdd.getNumPartitions() == 4
    every, names = [], ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-length")
    for path in (r.path for r in manifest.collect()):
        with open(path.removeprefix("file://"), "rb") as f:
            every += [warc.parse(raw) for raw in warc.read_archive(f)]
    assert len(every) == len(pages) and all(x[n] for x in every for n in names)
    assert len({x["warc-record-id"] for x in every}) == len(pages)
    targets = {x["warc-target-uri"] for x in every if x["warc-type"] == "response"}
    assert all(x["warc-refers-to-target-uri"] in targets for x in every if x["warc-type"] == "revisit")


def test_warc_rejects_damage(tmp_path):
    import io

    sink = io.BytesIO()
    w = warc.ArchiveWriter(sink, b"")
    w.write(warc.record("a", "2024-01-01T00:00:00Z", 1, "u", b"payload" * 50, False))
    whole = sink.getvalue()
    assert len(list(warc.read_archive(io.BytesIO(whole)))) == 1
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(whole[:-5])))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"12345678" + whole)))


def test_repeats(spark, docs, rows):
    got = {r.doc_id: r for r in suffix_array.remove_repeats(docs).collect()}
    texts = [(t or "").encode() for _, t in rows]
    for (d, _), t, flags in zip(rows, texts, brute.covered(texts), strict=True):
        kept = bytes(x for x, f in zip(t, flags, strict=True) if not f)
        spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(t), sum(flags), spans, hashlib.sha256(kept).hexdigest()), d


def test_repeats_of_repeated_rows(spark):
    t = words(random.Random(9), 60)
    d = spark.createDataFrame([(1, t), (1, t), (2, t), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_array.remove_repeats(d).collect()) == [(0, 0), (1, 0), (1, 0), (2, len(t.encode()))]


def test_intervals_give_all_maximal_repeats():
    rng = random.Random(5)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(60)).encode(), np.uint8)
    raw = data.tobytes()
    before = np.concatenate([[-1], data[:-1].astype(int)])
    order, common = suffix_array.enhanced(data, np.arange(60), np.full(60, 60), 60)
    length, bounds, found = suffix_array.maximal_repeats(order, common, before, 3)
    got = {(raw[found[a] : found[a] + n], tuple(sorted(found[a:b].tolist()))) for n, a, b in zip(length.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
    want = set()
    for s in {raw[i:j] for i in range(60) for j in range(i + 3, 61)}:
        at = [i for i in range(60) if raw[i : i + len(s)] == s]
        left, right = {raw[i - 1] if i else None for i in at}, {raw[i + len(s)] if i + len(s) < 60 else None for i in at}
        if len(at) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
            want.add((s, tuple(at)))
    assert got == want


def test_suffixes_that_differ_in_zero_bytes_only():
    texts = [b"x\0\0", b"x", b"x\0", b"x\0\0\0"]
    ends = np.cumsum([len(t) for t in texts])
    order, common = suffix_array.enhanced(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, 8)
    assert [texts[i] for i in order] == sorted(texts) and common.tolist() == [0, 1, 2, 3]


def meet(rows, level, least, **how):
    """What a shuffle and sort between two steps do, in one process."""
    import pyarrow as pa

    table = pa.Table.from_batches(list(rows)).sort_by([(c, "ascending") for c in level])
    return table.to_batches(max_chunksize=how.pop("chunk", 50))


def removed(texts, key_bytes, least=100):
    """Flags of removed bytes by the steps that Spark's tasks run, without Spark."""
    import pyarrow as pa

    names = ["id", "tx", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int64()), pa.array(texts, pa.binary())], names=names)
    asked: dict = {}
    for b in suffix_array._met(meet([suffix_array._anchor_rows(batch.slice(k, 20), least) for k in range(0, len(texts), 20)], ["key"], least)):
        for i, p in zip(b.column("id").to_pylist(), b.column("place").to_pylist(), strict=True):
            asked.setdefault(i, []).append(p)
    batch = batch.append_column("open", pa.array([asked.get(i, []) for i in range(len(texts))], pa.list_(pa.int64())))
    flags = [bytearray(len(t)) for t in texts]
    rows = [x for k in range(0, len(texts), 20) for x in suffix_array._contexts(batch.slice(k, 20), least, 69)]
    levels = 0
    for span in (23, 1, None):
        found = list(suffix_array._repeats(meet(rows, ["key", "bytes", "id", "tx", "start"], least), least, key_bytes)) if rows else []
        crowded = []
        for b in found:
            for i, x, y, raw in zip(*(b.column(c).to_pylist() for c in ("id", "start", "at", "bytes")), strict=True):
                if raw is None:
                    flags[i][x:y] = b"\1" * (y - x)
            crowded.append(b.filter(b.column("bytes").is_valid()))
        rows = [x for b in crowded for x in suffix_array._finer(b, least, span)] if span else crowded
        levels += any(b.num_rows for b in rows)
    return flags, levels


@pytest.mark.parametrize("key_bytes", [1 << 20, 700])
def test_repeats_at_every_level(key_bytes):
    texts = [(t or "").encode() for _, t in corpus(7, 80)]
    rng = random.Random(1)
    core = words(rng, 30).encode()
    texts += [words(rng, 8).encode() + core[: rng.randint(60, len(core))] + words(rng, 9).encode() for _ in range(120)]
    flags, levels = removed(texts, key_bytes)
    assert flags == brute.covered(texts)
    assert levels == (0 if key_bytes > 700 else 2)


def test_only_maximal_repeats_remove(monkeypatch):
    texts = [(t or "").encode() for _, t in corpus(7, 80)]
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(suffix_array, "maximal_repeats", lambda order, *_: (none, np.zeros(1, np.int64), none))
    for key_bytes in (1 << 20, 700):
        assert not any(map(any, removed(texts, key_bytes)[0]))


def test_repeats_of_a_crowded_anchor_stay_within_memory():
    """A million distinct contexts of one anchor pass through one task; what it holds is bounded by KEY_BYTES."""
    import tracemalloc

    import pyarrow as pa

    def batches():
        at = 0
        for _ in range(100):
            n = 10_000
            data = [b"a" * 40 + b"%07d" % (at + i) + b"b" * 70 for i in range(n)]
            k = np.zeros(n, np.int64)
            yield suffix_array._rows(k, data, np.arange(at, at + n), k, k, k + 8, False)
            at += n

    tracemalloc.start()
    out = sum(b.num_rows - b.column("bytes").null_count for b in suffix_array._repeats(batches(), 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == 1_000_000 and peak < 300 << 20, (out, peak)
    assert pa.total_allocated_bytes() < 300 << 20


def test_repeats_ids_at_the_edges(spark):
    t = words(random.Random(9), 60)
    least = -(1 << 63)
    d = spark.createDataFrame([(least, t), (None, "short"), ((1 << 63) - 1, t)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in suffix_array.remove_repeats(d).collect()}
    assert got == {least: 0, None: 0, (1 << 63) - 1: len(t.encode())}


def test_near_duplicates(spark, docs, rows, monkeypatch):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle_words=3, percent=85).collect()}
    for d, n, c in brute.components(rows):
        assert got[d] == (n, c, d == c), d


def test_near_copies_that_miss_their_leader(spark, monkeypatch):
    """A large group around one text whose members lie near the threshold from one another."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(240):
        w = list(base)
        for _ in range(rng.choice((2, 4, 6))):
            w[rng.randrange(200)] = f"n{rng.randrange(12)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 40_000)
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, shingle_words=3, percent=85).collect()}
    assert got == {i: c for i, _, c in brute.components(rows)}


def test_words_that_defeat_hashes_modulo_two_to_the_64(spark):
    a = "ab"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    raw = np.frombuffer((a + b).encode(), np.uint8)
    x, y = textbatch.PrefixHash(raw).of(np.array([0, 1024]), np.array([1024, 2048]))
    assert x != y


def test_exact_sets_are_the_sets():
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "b", "A", "é", "É"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["a\x1cb c", "", " \t\n", "a", "a a"]
    for width in (1, 3, 5):
        got = minhash.exact_sets(texts, width)
        want = [brute.shingles(t, width) for t in texts]
        for i, x in enumerate(want):
            assert len(got[i]) == len(x)
            for j, y in enumerate(want):
                assert len(np.intersect1d(got[i], got[j])) == len(x & y)


def test_joining_links_join_what_pairs_join():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(30)], np.uint64)) for _ in range(60)]
    found = minhash.joining_links(sets, np.arange(60), None, 45)
    root = list(range(60))

    def close(pairs):
        r = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                r[a] = r[b] = min(r[a], r[b])
        return r

    every = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 45 * len(np.union1d(sets[i], sets[j]))]
    assert close(found) == close(every) and len(found) < len(root) <= len(every)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}} or all(got.get(i, 0) == 0 for i in range(41))
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_url_levels(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.com.cn": ("x.com.cn", "com.cn"), "x.co.kr:80": ("x.co.kr", "co.kr"), "u:p@www.b.de": ("b.de", "de"), "10.0.0.7:8080": ("10.0.0.7", ""), "[::1]": ("[::1]", ""), "localhost": ("localhost", "localhost"), "com.io": ("com.io", "com.io"), "a.co.info": ("co.info", "info")}
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: (r.d, r.s) for r in d.select("host", *(x.alias(n) for x, n in zip(reputation.levels(F.col("host")), "ds", strict=True))).collect()} == hosts


def test_repeated_and_long_urls(spark):
    long = "http://bad.io/" + "x" * 200_000
    d = spark.createDataFrame([(1, long), (1, long), (None, "http://bad.io"), *((10 + i, f"http://u@bad.io:80/{i}") for i in range(40))], "page_id bigint, url string")
    labels = spark.createDataFrame([(10 + i, 0) for i in range(40)], "doc_id bigint, quality int")
    got = reputation.filter_urls(d, labels, F.col("quality") == 0).collect()
    assert len(got) == 43 and all(r.verdict == "block" for r in got) and {len(r.path) for r in got if r.page_id == 1} == {200_001}


def test_unequal_labels_count_as_toxic(spark):
    rows = [(i, "vile wretch here" if i % 2 else "good day here") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(200)] + [(i, 1) for i in range(200) if i % 2], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d.unionByName(d), toxicity.train(d, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in got)


def test_empty_sets_link_with_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d"), (4, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(d).collect())
    assert got == [("1", 1, True), ("2", 2, True), ("3", 3, True), ("3", 3, True), ("4", 3, False), ("None", None, True)]


def test_urls(spark):
    urls = ["http://A.NET/x", "https://www.example.net/en/1?q", "http://example.net/de/", "ftp://b.example.com/de/z#f", "http://x.org/fr/a", "net/", None, "http://internet/", "http://a.net", "http://bad.example.com/q", "http://sub.bad.example.com/", "http://good.co.uk/"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://bad.example.com/{i}") for i in range(30)] + [(200 + i, f"http://good.co.uk/{i}") for i in range(60)], "page_id bigint, url string").withColumn("host", F.lit(0))
    labels = spark.createDataFrame([(100 + i, 0) for i in range(30)] + [(200 + i, 1) for i in range(60)] + [(1, None)], "doc_id bigint, quality int")
    got = {r.page_id: r for r in reputation.filter_urls(d, labels, F.col("quality") == 0).collect()}
    assert [got[i].rule for i in range(9)] == ["net/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None]
    assert (got[0].host, got[0].path, got[1].path, got[5].host, got[6].path) == ("a.net", "/x", "/en/1", "", "")
    assert [got[i].verdict for i in (0, 1, 2, 3, 4)] == ["block", "allow", "block", "block", "allow"]
    assert got[9].verdict == "block" and got[11].verdict == "allow"
    none = reputation.filter_urls(d, labels.where("false"), F.col("quality") == 0)
    assert none.where("rule IS NULL AND verdict = 'block'").count() == 0


def test_fingerprints(spark, docs, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    for (d, t), e in zip(rows, brute.edited(rows), strict=True):
        assert (got[d].n_chars, got[d].edited_text) == (len(t or ""), e)

    def jaccard(a, b):
        of = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(brute.WORD.findall(t.translate(brute.ALPHA)))
        x, y = of(a), of(b)
        return len(x & y) / len(x | y) if x | y else 1.0

    errors = [abs(got[d].near_edited - jaccard(t or "", e)) for (d, t), e in zip(rows, brute.edited(rows), strict=True) if len((t or "").split()) > 30]
    assert np.mean(errors) < 0.06 and max(errors) < 0.25
    same = {}
    for d, t in rows:
        assert same.setdefault(t or "", got[d].fingerprint) == got[d].fingerprint
    assert got[60].fingerprint == "" and len(got[0].fingerprint) == 256


def test_fingerprints_of_short_texts(spark):
    # 9 shingles each, 6 of them shared: a Jaccard similarity of one half
    rows = [(" ".join(f"w{i}x{k}" for k in range(13)), " ".join(f"w{i}{'x' if k < 10 else 'y'}{k}" for k in range(13))) for i in range(400)]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("s")).collect()]
    assert abs(np.mean(got) - 0.5) < 0.02 and np.std(got) < 0.06, (np.mean(got), np.std(got))


def test_next_over_many_runs(spark, rows):
    d = spark.createDataFrame([(3 * i, f"text {i} " * 9) for i in range(97)], "id bigint, text string").repartition(6)
    got = {r.id: r.next_text for r in fingerprints.with_next(d, "id", {"text": F.col("text")}, {}, run_rows=7).collect()}
    assert len(got) == 97 and all(got[3 * i] == f"text {(i + 1) % 97} " * 9 for i in range(97))


@pytest.mark.parametrize("max_runs", [8_192, 5])
def test_next_of_any_ids(spark, max_runs):
    """String ids, a null, repeated ids and repeated rows, over many runs."""
    named = [(f"id-{i:04d}", f"text {i}") for i in range(300)]
    d = spark.createDataFrame([*named, (None, "none"), ("id-0007", "text 7"), ("id-0100", "other")], "id string, text string").repartition(6)
    got = sorted((r.id or "", r.text, r.next_text) for r in fingerprints.with_next(d, "id", {"text": F.col("text")}, {}, run_rows=7, max_runs=max_runs).collect())
    assert len(got) == 303
    following = {(i, t): n for i, t, n in got}
    assert following[("", "none")] == "text 0" and following[("id-0299", "text 299")] == "none"
    assert sorted(n for i, _, n in got if i == "id-0007") == ["text 7", "text 8"]
    assert {n for i, _, n in got if i == "id-0100"} in ({"other", "text 101"}, {"text 100", "text 101"})
    assert all(following[(f"id-{i:04d}", f"text {i}")] == f"text {i + 1}" for i in range(299) if i not in (7, 99, 100))
    assert following[("id-0099", "text 99")] in ("text 100", "other")


def test_fingerprint_against_a_plain_sketch(spark, docs, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    plain = {d: brute.sketch(t) for d, t in rows}
    assert all(got[d].fingerprint == plain[d] for d in plain)
    after = [d for d, _ in rows[1:]] + [rows[0][0]]
    for (d, _), e, nxt in zip(rows, brute.edited(rows), after, strict=True):
        other = brute.sketch(e)
        assert got[d].edited_fingerprint == other
        assert abs(got[d].near_edited - brute.sketch_likeness(plain[d], other)) < 1e-12 and abs(got[d].near_next - brute.sketch_likeness(plain[d], plain[nxt])) < 1e-12


def test_secrets(spark, docs, rows):
    ledger = secrets.BlobLedger(fresh_path(spark, "ledger"))
    got = {r.doc_id: r for r in ledger.scan(docs).collect()}
    for d, t in rows:
        base = [s for s in got[d].spans if s["rank"] < 3]
        assert [f"{s['kind']}:{s['start']}:{s['stop']}" for s in base] == brute.base_spans(t), d
    # a second version of the history: only new blobs are read
    more = spark.createDataFrame([(900, dict(rows)[6]), (901, "new secret=hunter2hunter2"), (901, "new secret=hunter2hunter2")], "doc_id bigint, text string")
    assert [r.text for r in ledger.unseen(more, "text").collect()] == ["new secret=hunter2hunter2"]
    second = ledger.scan(more).collect()
    assert len(second) == 3 and all(len(r.spans) for r in second)
    assert ledger.rows(more).groupBy("blob").count().where("count > 1").isEmpty()
    assert secrets.BlobLedger(ledger.path, "2").unseen(more, "text").count() == 2
    assert len(secrets.RULE_VERSION) == 16


def test_many_secrets_in_one_text(spark):
    """Both folds take about n log n steps, not n squared."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(24 + i % 3)) for i in range(20_000))
    d = spark.createDataFrame([(text,), ("secret=abcdef token=abcdef12 " * 3,)], "text string").select("text", secrets.find_spans(F.col("text")).alias("spans"))
    long, short = d.select("text", "spans", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [f"{s['kind']}:{s['start']}:{s['stop']}" for s in long.spans] == brute.base_spans(text) and len(long.spans) == 20_000
    assert long.t == " ".join(["[secret]"] * 20_000) and short.t == "[secret] [secret] " * 3


def test_redaction(spark):
    d = spark.createDataFrame([("é token=abcdef1 x AKIA" + "B" * 20,)], "text string").select("text", secrets.find_spans(F.col("text")).alias("spans"))
    assert d.select(secrets.redact(F.col("text"), F.col("spans")).alias("t")).first().t == "é [secret] x [secret]"


def test_bpe_matches_the_library(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = [t or "" for _, t in rows] + ["<|startoftext|>Hello<|endoftext|> World's ΟΔΟΣ İ 日本 1234 ﬁ ½ \x1c", "a" * 3001, "=-" * 900, "'S don't I'VE x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.encode_decode(d, outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert list(got[i].ids) == e.ids and got[i].n_tokens == len(e.ids)
        assert got[i].decoded == library.decode(e.ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()


def test_empty_tables(spark):
    d, p = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "page_id bigint, url string, html string")
    bench, labels = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert decontamination.decontaminate(d, bench).count() == 0
    assert toxicity.score(d, toxicity.train(d, labels)).count() == 0
    assert html_blocks.extract(p).count() == 0
    assert warc.read_archives(warc.write_archives(p, fresh_path(spark, "none"))).count() == 0
    assert suffix_array.remove_repeats(d).count() == 0
    assert minhash.near_duplicates(d).count() == 0
    assert reputation.filter_urls(p, labels, F.col("quality") == 0).count() == 0
    assert fingerprints.fingerprint_edits(d).count() == 0
    assert secrets.BlobLedger(fresh_path(spark, "ledger")).scan(d).count() == 0
    assert bpe.encode_decode(d).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, rng = corpus(4), random.Random(8)
    item = words(rng, 30)
    rows += [(500, words(rng, 20) + " " + item), (501, "clean " + words(rng, 40)), (502, words(rng, 12) + " secret=hunter2hunter2 " + words(rng, 12))]
    toxic = [(600 + i, words(rng, 12) + " vile wretch " + words(rng, 12)) for i in range(120)]
    clean = [(800 + i, words(rng, 25)) for i in range(120)]
    rows += toxic + clean
    twice = [(501, dict(rows)[501])] * 3
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in [*rows, *twice]], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(i, 1, int(i < 800)) for i, _ in toxic + clean], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: t or "" for i, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", "), name
        docs = docs.cache()
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":  # caught by what was learnt, held-out ones included
            assert not {i for i, _ in toxic} & set(after) and set(after) == set(texts) - {i for i, _ in toxic}
            assert docs.count() == len(after) + 3
    assert docs.count() == len(after)
    for i, r in after.items():
        base = brute.base_spans(texts[i])
        assert ("[secret]" in (r.text or "")) == bool(base) and not brute.base_spans(r.text), i
        assert base or (r.text or "") == texts[i]
        assert r.n_chars == len(r.text or "")
    assert after[502].text == texts[502].replace("secret=hunter2hunter2", "[secret]")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(got) == corpus_pipeline.run(spark, str(tmp_path)).count()
    sets = {i: brute.shingles(t, 5) for i, t in rows if (i, t) not in toxic}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    left = {i for i, r in root.items() if i == r} - {500}
    assert set(got) == left and 501 in got
    for i in got:
        assert got[i].n_tokens == len(bpe.model(bpe.default_path()).encode_batch([after[i].text or ""])[0]) // 4, i
