"""Vectorised text work on Arrow batches: bytes of many documents in one array, hashes from prefix sums.

A substring hash is a polynomial over two prime fields, mixed into one 64-bit value, so the hash of any
[start, end) costs two look-ups once the prefix sums of a chunk are known.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between JVM and worker; both hold several at a time.
BATCH_BYTES = 4 << 20

# Two primes below 2**31 and a base for each.
_FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_017))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: 1 where a lower-cased byte belongs to a word of digits, a-z and non-ASCII bytes.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: 1 where a byte is not ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc

    def _trim(pad: int) -> int:
        return 0


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, so that long texts don't make them large; a session's lower limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return memory that a finished batch no longer uses to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def _powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get(prime)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        both = []
        for b in (base, pow(base, -1, prime)):
            t = np.ones(1, np.uint64)
            while len(t) < size:
                step = np.uint64(pow(b, len(t), prime))
                t = np.concatenate([t, t * step % np.uint64(prime)])
            both.append(t[:size])
        have = _tables[prime] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PrefixHash:
    """Hashes of substrings of one byte array: polynomials over two prime fields, mixed into 64 bits.

    Two strings of at most n bytes hash alike with a probability of about (n / 2**31)**2; powers of two give no
    pattern, as the moduli are prime.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = []
        plus = data.astype(np.uint64) + np.uint64(1)
        for prime, base in _FIELDS:
            power, inverse = _powers(prime, base, n + 1)
            c = np.zeros(n + 1, np.uint64)
            np.cumsum(plus * power[:n] % np.uint64(prime), out=c[1:])
            self.sums.append((np.uint64(prime), c, inverse))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((c[end] - c[start]) % p * i[start] % p for p, c, i in self.sums)
        return mix(a << np.uint64(31) ^ mix(b + (end - start).astype(np.uint64)))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.fill_null("")
    else:
        column = column.fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of about ``limit`` bytes, at least one document each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs where ``table`` holds, within a document) and their document."""
    inside = table[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begin[first] = inside[first]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    finish[last] = inside[last]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(finish) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
