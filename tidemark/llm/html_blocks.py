"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags). Each block has a hashed vector of
its tag path (names, classes and ids of the open elements), a hashed vector of its words and a few
measures. A bidirectional LSTM in numpy reads the sequence and labels every block as main text or not.

The model is trained here, on pages drawn from a grammar of layouts whose labels are known by
construction; its size and the number of pages are parameters, so it does not depend on the corpus. Its
weights are kept in the shared folder under a hash of this module.

Reading a page takes time in proportion to its length, whatever its tags; a page's blocks are labelled as one
sequence, so its vectors (about 1 kB a block) stand in memory together.

Defined results: a null or empty page has an empty text; text inside script, style, template, svg,
iframe, canvas, audio and video is never a block, but of these only script and style reach to the end of the page if left
open; any other element left open ends with its page; a comment or tag that never ends reaches to the end of the page, a quote that is
never closed ends with its tag; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import inspect
import random
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import kept
from tidemark.llm.textbatch import ALNUM, LOWER, PrefixHash, bound_batches, give_back, words

PATH_DIM, WORD_DIM, MEASURES = 96, 32, 8
INPUT_DIM = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 16
TRAIN_PAGES = 3_000
SEED = 20_240_501
#: Blocks labelled at a time (a longer page is taken alone).
BATCH_BLOCKS = 12_000

#: A tag whose quotes are in order; no attempt reads past the next angle bracket, so reading is linear in the page.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
#: Any other tag is read attribute by attribute.
_OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_NEXT = re.compile(r"[\s/]*+([^\s/>=]*+)\s*+(=?)\s*+")
_BARE = re.compile(r"[^\s>]*+")
_RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}
#: What these hold is not text of the page. Without an end tag they are no more than their own tag.
_CUT = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("template", "svg", "iframe", "canvas", "audio", "video")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++))""", re.I)
# Elements of HTML that stay inside a line of text, and those that have no content.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
_INLINE |= frozenset("math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mprescripts mstyle mpadded mphantom merror menclose mtable mtr mtd".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset(("ul", "ol", "dl", "table", "select"))


@dataclass
class Block:
    text: str
    path: np.ndarray
    depth: int
    link_chars: int


_elements: dict[str, np.ndarray] = {}


def _hashed(marks: list[str]) -> np.ndarray:
    out = np.zeros(PATH_DIM, np.int32)
    for x in marks:
        h = zlib.crc32(x.encode())
        out[h % PATH_DIM] += 1 if h >> 31 else -1
    return out


def _element(name: str) -> np.ndarray:
    """Hashed vector of an element's name, classes, id and role."""
    got = _elements.get(name)
    if got is None:
        if len(_elements) > 20_000:
            _elements.clear()
        got = _elements[name] = _hashed([x for x in re.split(r"[\s_:-]+", name) if x])
    return got


class _Open:
    """The open elements. Each holds the sum of the vectors down to itself, so a block's path costs the same at any depth, and
    the places of every name are kept, so that no search goes through the whole stack."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[np.ndarray] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, marks: str) -> None:
        own = _element(marks)
        self.paths.append(self.paths[-1] + own if self.paths else own)
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def last(self, name: str) -> int:
        return (self.places.get(name) or (-1,))[-1]

    def close(self, at: int) -> None:
        """Close the element at this place and all within it."""
        for name in self.names[at:]:
            self.places[name].pop()
        del self.names[at:], self.paths[at:]


def _odd_tag(page: str, at: int, missing: set[str]) -> tuple[int, str]:
    """End of the tag whose attributes begin at ``at``, and its class, id and role. A quote that is never closed is none; ``missing`` holds quotes that no longer occur."""
    found, n = [], len(page)
    while True:
        m = _NEXT.match(page, at)
        at, value = m.end(), ""
        if at >= n:
            return n, " ".join(found)
        if m[2]:
            mark = page[at]
            end = -1
            if mark in "\"'" and mark not in missing:
                end = page.find(mark, at + 1)
                if end < 0:
                    missing.add(mark)
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        if m[1].lower() in ("class", "id", "role"):
            found.append(value)
        if at >= n:
            return n, " ".join(found)
        if page[at] == ">":
            return at + 1, " ".join(found)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, their white space collapsed; blocks without text are left out."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked, in_link = 0, False
    nowhere = np.zeros(PATH_DIM, np.int32)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                path = opened.paths[-1] + _element("leaf " + opened.names[-1]) if opened.names else nowhere
                out.append(Block(text, path, len(opened.names), linked))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if in_link:
            linked += len(piece)

    at, n = 0, len(page)
    unclosed: set[str] = set()
    missing: set[str] = set()
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
            continue
        if m := _TAG.match(page, start):
            at = m.end()
            rest = m[3]
            marks = "".join(" " + (x[1] or x[2] or x[3] or "") for x in _ATTRIBUTE.findall(rest)) if rest else ""
        elif m := _OPENING.match(page, start):
            at, marks = _odd_tag(page, m.end(), missing)
            marks = " " + marks
        else:
            add("<")
            at = start + 1
            continue
        closing, name = m[1], m[2].lower()
        empty = page[at - 2] == "/"
        if name in _RAW:
            if not closing:
                end = _RAW[name].search(page, at)
                at = end.end() if end else n
            continue
        if name in _CUT:
            if not closing and name not in unclosed and not (name == "svg" and empty):
                if end := _CUT[name].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(name)
            continue
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            elif name in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            if (k := opened.last(name)) >= 0:
                opened.close(k)
            continue
        if opened.names and opened.names[-1] == "p":
            opened.close(len(opened.names) - 1)
        for other in _CLOSED_BY.get(name, ()):
            k = opened.last(other)
            if k >= 0 and k > max(map(opened.last, _HOLDS)):
                opened.close(k)
        if name not in _VOID and not empty:
            opened.push(name, (name + marks).lower())
    flush()
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT_DIM), np.float32)
    raw = [b.text.encode() for b in blocks]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    start, end, owner = words(data, np.concatenate([[0], np.cumsum(sizes)]), ALNUM)
    if len(start):
        h = PrefixHash(data).of(start, end)
        at = owner * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)
        bag = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.clip(bag / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(blocks))))[:, None], -2, 2)
    n_words = np.bincount(owner, minlength=len(blocks)) if len(start) else np.zeros(len(blocks))
    for i, b in enumerate(blocks):
        x[i, :PATH_DIM] = np.clip(b.path, -2, 2)
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(n_words[i]) / 3, min(1.0, b.link_chars / len(b.text)), b.text[-1] in ".!?…:;", "|" in b.text or "»" in b.text, "©" in b.text, min(b.depth, 12) / 6, n_words[i] < 4, 1.0)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTM layers of opposite direction under a linear output that also sees the block itself."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"o": draw(2 * HIDDEN, 1), "s": 0.1 * draw(INPUT_DIM, 1), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(INPUT_DIM, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """x: pages x blocks x inputs; mask 1 for real blocks. Logits, and what the backward pass needs."""
        n, steps, _ = x.shape
        held: dict = {}
        sides = []
        for d in "fb":
            gates = x.reshape(-1, INPUT_DIM) @ self.p[f"x{d}"] + self.p[f"c{d}"]
            gates = gates.reshape(n, steps, -1)
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            out = np.zeros((n, steps, HIDDEN), np.float32)
            log = {}
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a = gates[:, t] + h @ self.p[f"h{d}"]
                s = _sigmoid(a[:, : 3 * HIDDEN])
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                g = np.tanh(a[:, 3 * HIDDEN :])
                m = mask[:, t, None]
                new = f * c + i * g
                th = np.tanh(new)
                if keep:
                    log[t] = (h, c, i, f, o, g, th, m)
                c = m * new + (1 - m) * c
                h = m * (o * th) + (1 - m) * h
                out[:, t] = h
            sides.append(out)
            held[d] = log
        both = np.concatenate(sides, axis=2)
        logit = (both @ self.p["o"] + x @ self.p["s"])[:, :, 0] + self.p["b"]
        return logit, {"both": both, **held}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        logit, held = self.forward(x, mask, True)
        n, steps, _ = x.shape
        d = ((_sigmoid(logit) - y) * mask / max(1.0, mask.sum()))[:, :, None].astype(np.float32)
        g = {"o": held["both"].reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "s": x.reshape(-1, INPUT_DIM).T @ d.reshape(-1, 1), "b": d.sum(axis=(0, 1))}
        both = d @ self.p["o"].T
        for k, side in enumerate("fb"):
            dx = np.zeros((n, steps, 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{side}"])
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                h, c, i, f, o, gg, th, m = held[side][t]
                dh = dh + both[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                on, oc = dh * m, dc * m + dh * m * o * (1 - th * th)
                a = np.concatenate([oc * gg * i * (1 - i), oc * c * f * (1 - f), on * th * o * (1 - o), oc * i * (1 - gg * gg)], axis=1)
                dx[:, t] = a
                gh += h.T @ a
                dh = dh * (1 - m) + a @ self.p[f"h{side}"].T
                dc = dc * (1 - m) + oc * f
            flat = dx.reshape(-1, 4 * HIDDEN)
            g |= {f"x{side}": x.reshape(-1, INPUT_DIM).T @ flat, f"h{side}": gh, f"c{side}": flat.sum(axis=0)}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 5, size: int = 32, rate: float = 0.01, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * (-(-len(pages) // size))
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for s in range(0, len(order), size):
                x, mask, y = padded([pages[i][0] for i in order[s : s + size]], [pages[i][1] for i in order[s : s + size]])
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def padded(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x = np.zeros((len(xs), steps, INPUT_DIM), np.float32)
    mask, y = np.zeros((len(xs), steps), np.float32), np.zeros((len(xs), steps), np.float32)
    for k, v in enumerate(xs):
        x[k, : len(v)], mask[k, : len(v)] = v, 1
        if ys is not None:
            y[k, : len(v)] = ys[k]
    return x, mask, y


# Names under which layouts mark their parts.
_PARTS = {
    "menu": ("nav", "menu", "navbar", "navigation", "main-nav", "topnav", "breadcrumb", "breadcrumbs", "nav-menu", "tabs", "pagination", "pager", "toc", "skip-link"),
    "header": ("header", "masthead", "site-header", "topbar", "branding", "logo", "page-header", "site-title", "top"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "colophon", "legal", "foot"),
    "sidebar": ("sidebar", "side", "widget", "related", "aside", "recent-posts", "popular", "recommended", "trending", "tags", "author-box", "more-stories"),
    "notice": ("cookie", "cookies", "cookie-banner", "consent", "gdpr", "notice", "alert", "banner", "popup", "modal", "warning", "message", "privacy"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad-slot", "sponsor", "adsbox", "banner-ad", "teaser"),
    "form": ("form", "search", "newsletter", "subscribe", "signup", "login", "contact-form", "search-form"),
    "comments": ("comments", "comment", "commentlist", "comment-list", "replies", "respond", "discussion", "disqus", "reader-comments", "comment-body", "feedback"),
    "share": ("share", "social", "share-buttons", "social-links", "follow"),
}
_TAG_OF = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}
_MAIN = ("content", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "text", "main", "main-content", "page-content", "body", "post-content", "article-text")
_STOCK = "Home|About|Contact|Login|Search|Subscribe to our newsletter|All rights reserved|Privacy policy|Terms of use|Accept cookies|We use cookies|Read more|Share|Reply|Leave a comment|Advertisement|Sponsored|Menu|Next|Previous|Related|Most read|Your e-mail|Send|Sign up|© 2024"


class _Layouts:
    """Random pages: parts of a page in random order and marking, with the words that are main text known."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.bits = ["".join(self.r.choice(c) for c in self.r.choice((("bdglmnprstv", "aeiouéäö"), ("aeiou", "nrstl"), ("bdglmnprst", "aeiou", "nrst")))) for _ in range(140)]

    def words(self, n: int) -> str:
        r = self.r
        w = ["".join(r.choice(self.bits) for _ in range(r.choice((1, 1, 2, 2, 3)))) + (r.choice((",", "&amp;", "***", "%%%")) if r.random() < 0.06 else "") for _ in range(n)]
        return " ".join(w)

    def sentence(self, n: int) -> str:
        return self.words(n).capitalize() + self.r.choice("....!?")

    def prose(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return self.words(r.randint(1, 9))
        text = " ".join(self.sentence(r.randint(1, 18)) for _ in range(r.choice((1, 1, 2, 3, 5))))
        k = r.random()
        if k < 0.25:  # main text can be as odd as the rest of a page
            text = text.replace(" ", r.choice((" | ", "*** ", "%%% ", "### ", " &amp;&amp;&amp; ", " » ", " - ")))
        return text if k > 0.05 else " ".join([text.split()[0]] * r.randint(2, 40))

    def mark(self, names: tuple[str, ...]) -> str:
        r = self.r
        return r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {r.choice(("box", "wrap", "col", "block", "row"))}"'))

    def paragraph(self) -> str:
        r = self.r
        t = self.prose()
        k = r.random()
        if k < 0.12:
            t = f"<b>{t}<br>" if r.random() < 0.5 else f"<b>{t}</b>"
        elif k < 0.2:
            t = f'{t} <a href="/{r.randint(1, 99)}">{self.words(2)}</a> {self.words(3)}.'
        return r.choice((f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}"))

    def main(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.72:
            return self.paragraph()
        if k < 0.8:
            return f"<h{(h := r.randint(2, 4))}>{self.words(r.randint(1, 7))}</h{h}>"
        if k < 0.88:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.prose()}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if k < 0.92:
            return f"<blockquote>{self.paragraph()}</blockquote>"
        if k < 0.95:
            return f"<pre>{self.words(8)}</pre>"
        if k < 0.98:
            return "<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(2)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        return f"<div>{self.prose()}</div>"

    def other(self, kind: str) -> str:
        r = self.r
        plain = r.random() < 0.35
        tag = _TAG_OF.get(kind, "div") if plain else r.choice(("div", "div", "section", _TAG_OF.get(kind, "div")))
        mark = "" if plain and tag != "div" and tag != "section" else self.mark(_PARTS[kind])
        stock = lambda: r.choice(_STOCK.split("|")) if r.random() < 0.4 else self.words(r.randint(1, 3))
        if kind in ("menu", "share"):
            inner = "<ul>" + "".join(f'<li><a href="/{r.randint(1, 99)}">{stock()}</a></li>' for _ in range(r.randint(2, 8))) + "</ul>" if r.random() < 0.7 else " | ".join(f'<a href="/x">{stock()}</a>' for _ in range(r.randint(2, 6)))
        elif kind == "form":
            inner = f"<label>{stock()}</label><input><button>{stock()}</button>" if r.random() < 0.5 else f"<p>{self.prose()}</p><form><input><select><option>{stock()}<option>{stock()}</select><button>{stock()}</button></form>"
        elif kind == "comments":
            inner = (f"<h3>{stock()}</h3>" if r.random() < 0.6 else "") + "".join(r.choice((f'<div class="comment"><b>{self.words(1)}</b>{self.paragraph()}</div>', f"<li>{self.paragraph()}</li>", self.paragraph())) for _ in range(r.randint(1, 5)))
        elif kind in ("header", "footer"):
            inner = r.choice((f"<p>{stock()}</p>", f"&copy; {self.words(1)} &middot; {self.prose()}", f"<h1>{self.words(2)}</h1><p>{self.words(4)}</p>" if kind == "header" else f"<p>{self.prose()}</p>", self.prose()))
        else:
            inner = r.choice((self.prose(), f"<p>{self.prose()}</p>", f"<h3>{stock()}</h3><ul>" + "".join(f'<li><a href="/y">{self.words(4)}</a></li>' for _ in range(r.randint(1, 5))) + "</ul>", f"<p>{self.prose()}</p><p>{self.prose()}</p>"))
        return f"<{tag}{mark}>{inner}</{tag}>"

    def page(self) -> str:
        """A page in which main text stands between two control characters."""
        r = self.r
        kinds = [*_PARTS]
        some = lambda least, most: [self.other(r.choice(kinds)) for _ in range(r.randint(least, most))]
        title = self.words(r.randint(1, 9))
        body = [f"<h1>{title}</h1>"] * (r.random() < 0.75) + [self.main() for _ in range(r.choice((1, 2, 3, 5, 8, 14)))]
        flagged = [f"\1{b}\2" for b in body]
        for _ in range(r.choice((0, 0, 1, 2))):
            flagged.insert(r.randint(0, len(flagged)), self.other(r.choice(("advert", "notice", "sidebar", "share", "form"))))
        if r.random() < 0.2:
            flagged.append(self.other("comments"))
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        mark = self.mark(_MAIN) if tag in ("div", "section") or r.random() < 0.3 else ""
        block = f"<{tag}{mark}>{''.join(flagged)}</{tag}>"
        for _ in range(r.choice((0, 0, 1, 2))):
            outer = r.choice(("div", "main", "section"))
            block = f"<{outer}{self.mark((*_MAIN, 'wrapper', 'container', 'page', 'row')) if outer != 'main' else ''}>{block}{''.join(some(0, 1))}</{outer}>"
        tail = [self.other("comments")] * (r.random() < 0.35) + some(0, 2) + [self.other("footer")] * (r.random() < 0.8)
        lead = [self.other("menu")] * (r.random() < 0.7) + [self.other("header")] * (r.random() < 0.5) + some(0, 3)
        r.shuffle(lead)
        head = f"<head><title>{title}</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(lead)}{block}{''.join(tail)}</body></html>"


def _labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a drawn page. The marks stand outside the blocks' tags, so they are cut out before reading."""
    spans, clean, at = [], [], 0
    for m in re.finditer("[\1\2]", page):
        clean.append(page[at : m.start()])
        spans.append((sum(map(len, clean)), m[0]))
        at = m.end()
    clean.append(page[at:])
    whole = "".join(clean)
    # a block's label: mark every main part's text with a private letter, read again, and see which blocks carry it
    flagged, at, inside = [], 0, False
    for pos, kind in [*spans, (len(whole), "")]:
        piece = whole[at:pos]
        flagged.append(re.sub(r">([^<]*[^<\s][^<]*)", ">\ue000\\1", piece) if inside else piece)
        at, inside = pos, kind == "\1"
    marked = leaf_blocks("".join(flagged))
    blocks = leaf_blocks(whole)
    return vectors(blocks), np.array(["\ue000" in b.text for b in marked], np.float32)


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> BiLstm:
    draw = _Layouts(seed)
    model = BiLstm(seed)
    model.fit([_labelled(draw.page()) for _ in range(pages)])
    return model


def _source() -> str:
    """Names the model by all that it follows from."""
    return hashlib.sha256(f"{inspect.getsource(sys.modules[__name__])} {TRAIN_PAGES} {SEED} {np.__version__}".encode()).hexdigest()


_SHAPES = "name string, shape array<bigint>, weights array<double>"


def kept_model(spark: SparkSession) -> BiLstm:
    """The trained model: from this process, else from the shared folder, else trained and written there."""
    if _ready:
        return _ready[0]

    def rows() -> list[tuple]:
        return [(k, list(v.shape), v.reshape(-1).astype(float).tolist()) for k, v in trained().p.items()]

    model = BiLstm()
    model.p = {r["name"]: np.array(r["weights"], np.float32).reshape(r["shape"]) for r in kept(spark, f"html-{_source()}", rows, _SHAPES).collect()}
    _ready.append(model)
    return model


_ready: list[BiLstm] = []


def extract_batch(pages: list[str | None], model: BiLstm) -> list[str]:
    found = [leaf_blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(found[order[end]]) * (end + 1 - at) <= BATCH_BLOCKS:
            end += 1
        part = order[at:end]
        every = vectors([b for i in part for b in found[i]])
        x, mask, _ = padded(np.split(every, np.cumsum([len(found[i]) for i in part])[:-1]))
        logit, _ = model.forward(x, mask)
        for k, i in enumerate(part):
            out[i] = "\n\n".join(b.text for b, s in zip(found[i], logit[k], strict=False) if s > 0)
        at = end
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BiLstm | None = None) -> DataFrame:
    """id, url and main text of every page."""
    bound_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast((model or kept_model(pages.sparkSession)).p)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiLstm()
        net.p = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                part = batch.slice(a, 400)
                texts = extract_batch(part.column("html").to_pylist(), net)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])
            give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
