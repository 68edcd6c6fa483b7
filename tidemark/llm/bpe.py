"""Byte-pair encoding and decoding with a published vocabulary, in batched numpy merge rounds.

The distinct words of a batch lie in one flat symbol array. Each round looks up every adjacent pair by
binary search over the sorted pair keys, takes the lowest rank of each word, and merges all its
non-overlapping occurrences from the left. Documents are then joined from their words' ids.

Defined results: a null or empty text has no tokens; a word that a vocabulary's bytes cover always
encodes; special tokens written in a text are encoded as themselves; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbatch import bound_batches, give_back

#: Words kept between batches by one worker; beyond it the memory starts anew (results do not change).
CACHE_WORDS = 150_000
#: Bytes of distinct words merged at a time.
MERGE_BYTES = 1 << 20
_END = "</w>"
_NONE = np.int64(1) << np.int64(40)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class WordBpe:
    """The merge table of a vocabulary whose words end in a marked symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.width = np.int64(len(self.tokens))
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + _END] for c in letters], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        product = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.product = keys[order], order.astype(np.int64), product[order]
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (none is empty)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.final[np.frombuffer(b"".join(words), np.uint8)[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            product = np.zeros(len(sym), np.int64)
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[at] == key) & (word[:-1] == word[1:]))
            rank[hit], product[hit] = self.rank[at[hit]], self.product[at[hit]]
            new = np.ones(len(sym), bool)
            new[1:] = word[1:] != word[:-1]
            least = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            over = least == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            chosen = (rank == least) & ~over
            where = np.flatnonzero(chosen)
            # a pair of two equal symbols can overlap itself: every other one of a run counts
            fresh = np.ones(len(where), bool)
            fresh[1:] = where[1:] != where[:-1] + 1
            run = where[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(where) else where
            where = where[(where - run) % 2 == 0]
            sym[where] = product[where]
            stay = ~over
            stay[where + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")].astype("<u4")
        return np.split(sym, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order; a special token keeps its written form."""
        if self.marks is not None and any(m in text for m in self.special):
            out: list[str] = []
            for part in self.marks.split(text):
                out += [part] if part in self.special else self.pieces(part)
            return out
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split.findall(text.lower())

    def learn(self, found: set[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [w for w in found if w not in self.known]
        for w in [w for w in new if w in self.special]:
            self.known[w] = np.array([self.special[w]], "<u4").tobytes()
        new = [w for w in new if w not in self.special]
        size, run = 0, []
        for w in [*new, None]:
            if w is None or size > MERGE_BYTES:
                if run:
                    for x, ids in zip(run, self.merge([x.encode() for x in run]), strict=True):
                        self.known[x] = ids.tobytes()
                size, run = 0, []
            if w is not None:
                run.append(w)
                size += len(w)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        at = self.known.__getitem__
        return [b"".join(map(at, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
        give_back()
    return _models[path]


_KINDS = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """One row per document: its id and the asked ``outputs`` of {n_tokens, ids, ids_sha256, decoded, decoded_sha256}."""
    bound_batches(docs.sparkSession)
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                coded = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
                cols: dict[str, list] = {k: [] for k in outputs}
                for ids in coded:
                    text = bpe.decode(ids) if "decoded" in outputs or "decoded_sha256" in outputs else ""
                    for k in outputs:
                        cols[k].append(
                            len(ids) // 4 if k == "n_tokens"
                            else np.frombuffer(ids, "<i4") if k == "ids"
                            else hashlib.sha256(ids).hexdigest() if k == "ids_sha256"
                            else text if k == "decoded"
                            else hashlib.sha256(text.encode()).hexdigest()
                        )
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(cols[k], types[k]) for k in outputs)], names=["id", *outputs])
            give_back()

    out = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{k} {_KINDS[k]}" for k in outputs))
    return out.withColumnRenamed("id", id_col)
