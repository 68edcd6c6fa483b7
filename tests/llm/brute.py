"""Plain single-process versions of the queries' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALPHA = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def decontamination(docs, items):
    """docs: (id, text); items: (id, text). Returns rows (doc_id, n_words, n_hit, item ids)."""
    windows = defaultdict(set)
    for i, text in items:
        w = WORD.findall((text or "").translate(ALPHA))
        for s in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[s : s + 10])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = WORD.findall((text or "").translate(ALPHA))
        hit, ids = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def edited(docs):
    """docs: (id, text) in order. Returns the edited texts."""
    texts = [t or "" for _, t in docs]
    return [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]


def covered(texts, least=100):
    """Per text (bytes, in order): flags of bytes covered by a ``least``-byte string that also starts earlier."""
    seen, out = set(), []
    for t in texts:
        flags = bytearray(len(t))
        for s in range(len(t) - least + 1):
            x = t[s : s + least]
            if x in seen:
                flags[s : s + least] = b"\1" * least
            else:
                seen.add(x)
        out.append(flags)
    return out


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ALPHA))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs):
    """docs: (id, text). Returns rows (doc_id, n_shingles, component_id)."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posts = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            posts[x].append(k)
    for k, (d, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in posts[x]:
                if j < k:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d)) for d, s in sets]


def _h(*values):
    """Spark's xxhash64 of some values."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if isinstance(v, Long) else int(v).to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed & (1 << 64) - 1) if v is not None else seed
    return seed - (1 << 64) if seed >> 63 else seed


class Long(int):
    pass


def sketch(text):
    """One-permutation MinHash of five-word shingles in 256 bins, densified, four bits a bin."""
    w = [Long(_h(x)) for x in WORD.findall((text or "").translate(ALPHA))]
    if not w:
        return ""
    hashes = {_h(*w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    bins = {}
    for h in hashes:
        # bins are counted in signed order, so the upper half comes first
        b = (h >> 56) + 128
        rest = h & (1 << 56) - 1
        if rest != (1 << 56) - 1:
            bins[b] = min(bins.get(b, h), h)
    out = []
    for j in range(256):
        tries = [_h(j, t) % 256 for t in range(12)] + sorted(bins, key=lambda i: (_h(j, i, 12), i))
        at = j if j in bins else next(t for t in tries if t in bins)
        out.append(f"{_h(Long(bins[at]), j) & 15:x}")
    return "".join(out)


def sketch_likeness(a, b):
    if not a or not b:
        return float(a == b)
    share = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, min(1.0, (share - 1 / 16) / (15 / 16)))


# Elements within a line, and those whose content is no text of the page.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
SILENT = ("template", "svg", "iframe", "canvas", "audio", "video")


def block_texts(page):
    """Texts between block-level tags, read one character after another."""
    out, held, at = [], "", 0
    low = page.lower()

    def flush():
        nonlocal held
        text = " ".join(entities.unescape(held).split())
        if text:
            out.append(text)
        held = ""

    while at < len(page):
        if page[at] != "<":
            held += page[at]
            at += 1
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[at + 1 : at + 2] in ("!", "?") and page[at + 1 : at + 2]:
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            continue
        m = re.match(r"</?([a-z][a-z0-9:-]*)", low[at : at + 60])
        if not m:
            held += "<"
            at += 1
            continue
        closing, name = low[at + 1] == "/", m[1]
        at += m.end()
        value = False  # a quote opens a value after an equals sign only
        while at < len(page) and page[at] != ">":
            c = page[at]
            if value and c in "\"'" and page.find(c, at + 1) >= 0:
                at = page.find(c, at + 1) + 1
                value = False
                continue
            value = c == "=" or (value and c.isspace())
            at += 1
        at = min(len(page), at + 1)
        if name in ("script", "style", *SILENT) and not closing:
            end = re.compile(rf"</{name}\s*>").search(low, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
        elif name in INLINE:
            held += " " if name in ("br", "img", "input") else ""
        elif name not in ("script", "style", *SILENT):
            flush()
    flush()
    return out
