"""Document fingerprints by one-permutation MinHash with optimal densification.

Each five-word shingle is hashed once; its high bits name one of 256 bins and each bin keeps its least
value. An empty bin copies the first non-empty bin of its own hash sequence, which goes on until it meets one: some bins by hash, then
all bins in the order of a hash. A fingerprint is the
low four bits of every bin, packed to 128 bytes; likeness is the share of equal entries, corrected for
the chance of equal low bits.

Defined results: a text without words (null, empty) has an empty fingerprint, likeness 1 to another empty
one and 0 to any other; a text of one to four words is one shingle; documents are ordered by id (of any type that can be sorted), nulls
first, and equal ids by a hash of their text; repeated rows follow one another, and the last is followed by the first; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.native import alnum_words, let
from tidemark.llm.storage import materialize

SHINGLE_WORDS = 5
BIN_BITS = 8
LOW_BITS = 4
_BINS = 1 << BIN_BITS
_BELOW = 64 - BIN_BITS
_REST = (1 << _BELOW) - 1
#: Look-ups of a bin's sequence one by one, before the filled bins are ranked by their places in the rest of it.
_TRIES = 12
#: Documents of an ordered run when neighbours are found, the most runs, and the keys drawn for each.
RUN_ROWS = 5_000
MAX_RUNS = 8_192
SAMPLE_A_RUN = 16


def _shingles(text: Column) -> Column:
    def hashed(w: Column) -> Column:
        n = F.size(w)
        of = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE_WORDS)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE_WORDS, F.lit(0))), of))

    return let(F.transform(alnum_words(text), lambda x: F.xxhash64(x)), hashed)


def _least_of_bins(hashes: Column) -> Column:
    """256 values, null for an empty bin. A sentinel per bin is the largest value there, so one sort finds every least value."""
    sentinels = F.transform(F.sequence(F.lit(0), F.lit(_BINS - 1)), lambda j: F.shiftleft(j.cast("bigint"), _BELOW).bitwiseOR(F.lit(_REST)))
    ordered = F.sort_array(F.concat(hashes, sentinels))
    bin_of = lambda x: F.shiftrightunsigned(x, _BELOW)
    first = let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    # signed order puts bins 128-255 before 0-127; the position says nothing more than a fixed permutation of bins
    return F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_REST)) != _REST, x))


def _densified(bins: Column) -> Column:
    """A bin's sequence is ``_TRIES`` hashed bins, then all bins in the order of a hash of both; its first non-empty bin is copied."""

    def fill(d: Column, filled: Column) -> Column:
        probe = lambda j, t: F.pmod(F.xxhash64(j, F.lit(t)), F.lit(_BINS)).cast("int")
        rest = lambda j: F.get(d, F.array_min(F.transform(filled, lambda i: F.struct(F.xxhash64(j, i, F.lit(_TRIES)).alias("h"), i.alias("i"))))["i"])
        return F.transform(d, lambda x, j: F.coalesce(x, *(F.get(d, probe(j, t)) for t in range(_TRIES)), rest(j)))

    filled = lambda d: F.filter(F.transform(d, lambda x, j: F.when(x.isNotNull(), j)), lambda j: j.isNotNull())
    return let(bins, lambda d: let(filled(d), lambda f: fill(d, f)))


def fingerprint(text: Column) -> Column:
    """Lower-case hex of the packed low bits, empty if the text has no words."""
    # values are hashed with their bin first, so that copies of one value do not share one chance of equal low bits
    digits = lambda d: F.concat_ws("", F.transform(d, lambda x, j: F.lower(F.hex(F.xxhash64(x, j).bitwiseAND(F.lit((1 << LOW_BITS) - 1))))))
    return let(_shingles(text), lambda h: F.when(F.size(h) == 0, F.lit("")).otherwise(digits(_densified(_least_of_bins(h)))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    chance = 1.0 / (1 << LOW_BITS)
    equal = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    guess = (equal / F.lit(float(_BINS)) - chance) / (1 - chance)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), guess)))


def _cuts(rows: DataFrame, n: int, runs: int) -> DataFrame:
    """One row: sorted keys that part ``rows`` into about ``runs`` runs, from a sample by hash of about ``SAMPLE_A_RUN`` distinct keys a run."""
    share = min(1.0, runs * SAMPLE_A_RUN / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_000_007)) <= int(share * 1_000_000_007)).select("_key")
    every = drawn.agg(F.sort_array(F.collect_set("_key")).alias("keys"))
    step = F.greatest(F.lit(1), F.floor(F.size("keys") / F.lit(runs)).cast("int"))
    return every.select(F.filter("keys", lambda _, i: (i > 0) & (i % step == 0)).alias("cuts"))


def _run_of(key: Column, cuts: Column, runs: int) -> Column:
    """How many cuts are no greater than the key, by halving."""

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        above = F.get(cuts, mid) <= key
        return F.when(acc["lo"] < acc["hi"], F.struct(F.when(above, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(mid).alias("hi"))).otherwise(acc)

    rounds = F.sequence(F.lit(0), F.lit((runs * SAMPLE_A_RUN).bit_length()))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), half, lambda acc: acc["lo"])


def with_next(rows: DataFrame, order: str, carry: dict[str, Column], derive: dict[str, Column], run_rows: int = RUN_ROWS, max_runs: int = MAX_RUNS) -> DataFrame:
    """``rows`` and the ``derive`` columns, worked out once per row, with ``carry`` of the next row by ``order`` (any type that can be sorted), then by a hash of text, as next_<name>; the last row is followed by the first.

    Rows are cut into at most ``max_runs`` runs of about ``run_rows`` by keys drawn from all; the first row of a run is
    also sent to the end of the run before. What is sent to all tasks is one key a run.
    """
    rows = rows.withColumn("_tx", F.xxhash64("text"))
    rows = rows.withColumn("_key", F.struct(F.col(order).isNotNull().alias("some"), F.col(order).alias("key"), F.col("_tx").alias("tx")))
    n = rows.count()
    runs = min(max_runs, max(1, -(-n // run_rows)))
    if runs > 1:
        cuts = materialize(_cuts(rows, n, runs), "cuts")
        rows = rows.withColumn("_cuts", cuts.scalar()).withColumn("_run", _run_of(F.col("_key"), F.col("_cuts"), runs)).drop("_cuts")
    else:
        rows = rows.withColumn("_run", F.lit(0))
    # one row a run; the first run's first row goes to the end of the last
    firsts = materialize(rows.groupBy("_run").agg(F.min("_key").alias("_key")), "runs")
    by = Window.orderBy("_run")
    ends = firsts.select("_key", F.coalesce(F.lag("_run").over(by), F.max("_run").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    ghosts = rows.join(F.broadcast(ends), "_key").drop("_run").withColumnRenamed("_before", "_run").withColumn("_ghost", F.lit(True)).dropDuplicates(["_key", "_run"])
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts).withColumns(derive)
    w = Window.partitionBy("_run").orderBy("_ghost", "_key")
    for name, value in carry.items():
        both = both.withColumn(f"next_{name}", F.lead(value).over(w))
    return both.where(~F.col("_ghost")).drop("_run", "_tx", "_ghost", "_key")


def edited_text(text: Column, following: Column) -> Column:
    """The last half (rounded down) replaced by as many first characters of the following text, or all it has."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, edited text, both fingerprints and the likeness to the edited text's and the next document's."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    near = with_next(rows, "id", {"text": F.col("text"), "fp": F.col("fp")}, {"fp": fingerprint(F.col("text"))})
    near = near.select("id", "text", "fp", "next_fp", edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    near = near.withColumn("edited_fp", fingerprint(F.col("edited")))
    return near.select(F.col("id").alias(id_col), F.char_length("text").cast("long").alias("n_chars"), F.col("edited").alias("edited_text"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
