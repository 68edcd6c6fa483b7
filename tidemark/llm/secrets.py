"""Secret scans through an incremental blob ledger.

Every historical version of every path is content-addressed by SHA-256. The ledger is a table of
(blob, rule_version, spans); a scan reads only blobs that the ledger lacks under the current rule
version, each once, appends their findings, and joins findings back to all paths that held the blob.

Defined results: a null text is the empty blob, which has no spans; repeated rows give repeated results;
positions are code points, end exclusive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import let
from tidemark.llm.storage import exists

# Kind, pattern, group whose length is held to the least length (0: the whole match), least length.
BASE_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
EXTRA_RULES = (
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 27),
)
#: Follows from the rules, so that findings of other rules are never taken for those of these.
RULE_VERSION = hashlib.sha256(repr((BASE_RULES, EXTRA_RULES)).encode()).hexdigest()[:16]
_SPAN = "struct<start:int,rank:int,kind:string,stop:int>"


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Every value joined with all before it. Each round joins twice as far back, so n values take about n log n steps and no list is grown by one."""
    rounds = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(values) - F.lit(1))).cast("int"))).otherwise(F.array().cast("array<int>"))
    back = lambda acc, i, k: F.get(acc, i - F.pow(F.lit(2), k).cast("int"))
    step = lambda acc, k: F.transform(acc, lambda v, i: F.when(i >= F.pow(F.lit(2), k), join(back(acc, i, k), v)).otherwise(v))
    return F.aggregate(rounds, values, step)


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the non-overlapping matches: between them lie the pieces that the pattern splits off."""
    p = F.lit(pattern)
    matches = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.char_length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda x: F.char_length(x)).alias("held"),
    )
    ends = lambda ms: _scan(F.transform(ms, lambda m: m["gap"] + F.coalesce(m["size"], F.lit(0))), lambda a, b: a + b)
    span = lambda m, end: F.when(m["held"] >= least, F.struct((end - m["size"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("stop")).cast(_SPAN))
    found = F.filter(let(matches, lambda ms: F.zip_with(ms, ends(ms), span)), lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find_spans(text: Column) -> Column:
    """All spans of a text, base and added, by start and then kind in the rules' order."""
    rules = (*BASE_RULES, *EXTRA_RULES)
    return F.sort_array(F.concat(*(_spans(text, i, *rule) for i, rule in enumerate(rules))))


@dataclass(frozen=True)
class BlobLedger:
    """A ledger table at ``path``, a folder that driver and executors share."""

    path: str
    rule_version: str = RULE_VERSION

    def rows(self, history: DataFrame) -> DataFrame | None:
        spark = history.sparkSession
        if not exists(spark, self.path):
            return None
        return spark.read.schema(f"blob string, rule_version string, spans array<{_SPAN}>").parquet(self.path).where(F.col("rule_version") == self.rule_version)

    def unseen(self, history: DataFrame, text_col: str) -> DataFrame:
        """blob, text of each blob that has no entry under this rule version, once."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        blobs = history.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
        known = self.rows(history)
        if known is not None:
            blobs = blobs.join(known.select("blob"), "blob", "left_anti")
        return blobs.groupBy("blob").agg(F.first("text").alias("text"))

    def scan(self, history: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """Bring the ledger up to date with ``history`` and return ``keep`` columns, blob and spans for all its rows."""
        found = self.unseen(history, text_col).select("blob", F.lit(self.rule_version).alias("rule_version"), find_spans(F.col("text")).alias("spans"))
        found.write.mode("append").parquet(self.path)
        # a blob found by two writers at once has two equal entries
        entries = self.rows(history).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
        paths = history.select(*keep, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob"))
        return paths.join(entries, "blob", "left").select(*keep, "blob", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span (overlapping ones as one) replaced by ``mark``."""

    def cut(ends: Column) -> Column:
        # where all spans before this one end; a span that begins earlier is part of one of them
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit(mark))).otherwise(F.lit(""))
        return F.concat_ws("", F.transform(spans, piece), F.substring(text, F.get(ends, F.size(ends) - 1) + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, let(_scan(F.transform(spans, lambda s: s["stop"]), F.greatest), cut)).otherwise(text)
