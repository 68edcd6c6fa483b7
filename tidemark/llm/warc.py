"""WARC archives compressed record by record against a Zstandard dictionary.

A dictionary is built once from a bounded sample of records. Each archive opens with a skippable frame
that holds it, so a file explains itself; every record is one Zstandard frame of its own. Records whose
payload digest was archived under a smaller id become revisits without payload.

Archives are written by the executors to a folder all can reach (any URI that pyarrow knows), each under
its own name and moved into place when complete, so that a repeated task leaves whole files only; the
manifest lists the files of the tasks that counted, and reading goes by the manifest.

Every record has the mandatory fields of WARC/1.1, and an id that follows from its archive and place, so that pages of equal or null id
have records of their own. Page ids, which WARC has no field for, stand in fields of this module. The dictionary is built from
the first 128 kB of a record; records themselves are whole.

Defined results: ids are integers (a text that is no number fails); white space of a url becomes single spaces; a null payload is empty; of equal payloads of at least ``min_revisit`` bytes the
smallest id is the response, a null id only if there is no other; repeated rows of that id are all
responses; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import small
from tidemark.llm.storage import materialize
from tidemark.llm.textbatch import BATCH_BYTES, bound_batches, give_back

#: Fixed value: magic number of the skippable frame that carries a dictionary.
DICT_MAGIC = 0x184D2A5D
SAMPLE_RECORDS = 1_000
DICT_BYTES = 64 << 10
#: Uncompressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 128 << 20
#: Partitions that read archives, at most; beyond so many archives a task reads several, one after another.
READ_TASKS = 20_000
LEVEL = 6
_CRLF = b"\r\n"


def _open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, date: str, page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record; the HTTP head of a revisit still gives the payload's length. A page without a url is its own target."""
    page = lambda i: f"urn:page:{'' if i is None else i}"
    target = lambda i, u: " ".join((u or "").split()) or page(i)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {target(page_id, url)}", f"Page-ID: {page(page_id)}", f"Page-Has-URL: {'no' if url is None else 'yes'}"]
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {target(refers_to, refers_url)}", f"Page-Refers-To: {page(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return _CRLF.join([*(h.encode() for h in head), b"", block, b"", b""])


def parse(raw: bytes) -> dict:
    """A record's WARC headers (lower-cased names), the length its HTTP head states, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(_CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = dict((k.strip().lower().decode(), v.strip().decode()) for k, _, v in (x.partition(b":") for x in lines[1:]))
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.partition(b":")[2]) for x in http.split(_CRLF) if x.lower().startswith(b"content-length:"))
    return fields | {"http-length": stated, "payload": payload}


def build_dictionary(samples: list[bytes]) -> bytes:
    """Empty if the samples are too few or too small to build one from."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    def __init__(self, sink, dictionary: bytes):
        self.sink = sink
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=given)
        sink.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)

    def write(self, raw: bytes) -> None:
        self.sink.write(self.coder.compress(raw))


def read_archive(source) -> Iterator[bytes]:
    """Records of an open archive, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = source.read(size)
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    held, out, frame = b"", [], coder.decompressobj()
    while held or (held := source.read(1 << 20)):
        out.append(frame.decompress(held))
        held = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(out)
            out, frame = [], coder.decompressobj()
    if out:
        raise ValueError("the last record is cut off")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Write all records below ``folder``, dated ``date`` (the time of this call, as the table has none); returns the manifest (path, records)."""
    bound_batches(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # a bounded sample, spread over the table by a hash
    n = max(1, pages.count())
    drawn = rows.where(F.pmod(F.xxhash64("id", "url"), F.lit(1_000_000)) < int(min(1.0, 2 * SAMPLE_RECORDS / n) * 1_000_000)).limit(SAMPLE_RECORDS)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = sorted(record("", date, i, u, p[: 1 << 17], False) for b in batches for i, u, p in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([build_dictionary(raw)], pa.binary())], names=["d"])

    dictionary = b"".join(bytes(r["d"]) for r in drawn.repartition(1).mapInArrow(fit, "d binary").collect())
    keyed = rows.withColumn("digest", F.sha1("payload"))
    shared = keyed.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first", "first_url")
    shared = materialize(shared, "copies")
    marked = keyed.join(small(shared, shared.count(), 500_000), "digest", "left").select("id", "url", "payload", "first", "first_url")
    as_revisit = marked.withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= min_revisit))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        made, writer, sink, name, size, count = [], None, None, "", 0, 0

        def close() -> None:
            sink.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            made.append((f"{folder}/{name}", count))

        for batch in batches:
            for i, u, p, first, first_url, again in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "first", "first_url", "revisit")), strict=True):
                if writer is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    sink = fs.open_output_stream(f"{base}/.{name}", compression=None)  # not by the name: records are compressed here
                    writer = ArchiveWriter(sink, dictionary)
                raw = record(f"{name}#{count}", date, i, u, p, again, first, first_url)
                writer.write(raw)
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    close()
                    writer = None
            give_back()
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return materialize(as_revisit.mapInArrow(write, "path string, records bigint"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True, tasks: int = READ_TASKS) -> DataFrame:
    """Every record of the listed archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to and, if asked, payload."""

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("urn:page:")
        return int(digits) if digits else None

    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"][: 7 if payloads else 6]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = _open_fs(path)
                with fs.open_input_stream(at, compression=None) as source:
                    rows, size = [], 0
                    for raw in read_archive(source):
                        x = parse(raw)
                        digest = x["warc-payload-digest"].removeprefix("sha1:")
                        if x["warc-type"] == "response" and digest_of(x["payload"]) != digest:
                            raise ValueError(f"payload and digest differ in {path}")
                        rows.append((number(x["page-id"]), x["warc-target-uri"] if x["page-has-url"] == "yes" else None, x["warc-type"], digest, x["http-length"], number(x.get("page-refers-to")), x["payload"])[: len(names)])
                        size += len(raw)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    kinds = dict(zip(["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"], ["bigint", "string", "string", "string", "bigint", "bigint", "binary"], strict=True))
    # one archive is the unit of reading; a stated number of partitions is not merged, however small the manifest is
    n = min(tasks, max(1, manifest.count()))
    return manifest.select("path").repartition(n, "path").mapInArrow(read, ", ".join(f"{n} {kinds[n]}" for n in names))
