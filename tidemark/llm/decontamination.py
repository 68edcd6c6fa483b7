"""Benchmark decontamination over a stored positional inverted index.

The index holds a posting (term, document, position) for every corpus token whose term occurs in the
benchmark. Corpus frequencies come from the postings. Each window of an item is looked up by its two
rarest terms: their posting lists, shifted by the terms' offsets in the item, meet in an alignment
(document, item, shift) only where both agree. Alignments are then compared word by word with the text; a
document's row holds the words of an item once, whatever the number of its alignments.

Defined results: a null text or text without words has no words and is never hit; an item without words
is ignored; items that repeat count once per distinct ``item_id``; a null ``item_id`` can hit but is not
listed; rows with equal ``doc_id`` are told apart by their text; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.native import alnum_words, let, small
from tidemark.llm.storage import materialize

WINDOW = 10
#: Terms whose lists are intersected before a window's alignment is compared with the text.
RAREST = 2
#: Bytes of an item table that may be broadcast.
SENT_BYTES = 48 << 20


@dataclass(frozen=True)
class PositionalIndex:
    """``postings``: term (64-bit hash), id, tx (hash of the text), pos. ``terms``: term, n (corpus frequency)."""

    postings: DataFrame
    terms: DataFrame


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, ik (its key), words; items with words only, each text of an item once."""
    got = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    got = got.select("item_id", F.xxhash64("item_id", "text").alias("ik"), alnum_words(F.col("text")).alias("words"))
    return got.where(F.size("words") > 0).dropDuplicates(["ik"])


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Postings of every term that ``items`` holds, written once to the shared folder."""
    vocabulary = materialize(items.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("term")).distinct(), "vocabulary")
    tokens = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tx"), F.posexplode(alnum_words(F.col(text_col).cast("string"))).alias("pos", "word"))
    tokens = tokens.select(F.xxhash64("word").alias("term"), "id", "tx", "pos")
    postings = materialize(tokens.join(small(vocabulary, vocabulary.count()), "term", "left_semi"), "postings")
    return PositionalIndex(postings, materialize(postings.groupBy("term").agg(F.count("*").alias("n")), "terms"))


def _sent(rows: DataFrame, size: Column) -> DataFrame:
    """``rows`` of a written table, marked for broadcast if their bytes are within ``SENT_BYTES``."""
    total = rows.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(rows) if total <= SENT_BYTES else rows


def _lookups(index: PositionalIndex, items: DataFrame, window: int, rarest: int) -> DataFrame:
    """ik, s, off, term: for each window (start s) of an item whose terms all occur, its rarest terms' offsets."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - F.lit(window), F.lit(0)))
    rows = items.select("ik", "words", F.explode(starts).alias("s"))
    rows = rows.select("ik", "s", F.posexplode(F.slice("words", F.col("s") + 1, window)).alias("o", "word"))
    rows = rows.select("ik", "s", (F.col("s") + F.col("o")).alias("off"), F.xxhash64("word").alias("term"))
    rows = rows.join(index.terms, "term", "left")
    by = Window.partitionBy("ik", "s")
    rows = rows.withColumn("missing", F.count_if(F.col("n").isNull()).over(by)).where("missing = 0")
    return rows.withColumn("rank", F.row_number().over(by.orderBy("n", "term", "off"))).where(F.col("rank") <= rarest).select("ik", "s", "off", "term")


def alignments(index: PositionalIndex, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """id, tx, ik, shift: where the shifted lists of all the rarest terms of some window of the item meet."""
    chosen = materialize(_lookups(index, items, window, rarest), "lookups")
    anchors = chosen.select("term", "ik", "off").distinct()
    needs = materialize(chosen.groupBy("ik", "s").agg(F.sort_array(F.collect_set("off")).alias("offs")).groupBy("ik").agg(F.collect_set("offs").alias("needs")), "needs")
    met = index.postings.join(small(anchors, anchors.count()), "term")
    met = met.groupBy("id", "tx", "ik", (F.col("pos") - F.col("off")).alias("shift")).agg(F.collect_set("off").alias("offs"))
    met = met.join(_sent(needs, F.size("needs") * (rarest + 2) * 8), "ik")
    return met.where(F.exists("needs", lambda w: F.size(F.array_except(w, F.col("offs"))) == 0)).select("id", "tx", "ik", "shift")


def proximity_matches(index: PositionalIndex, items: DataFrame, slop: int, rarest: int = RAREST) -> DataFrame:
    """id, tx, item_id, start: every place from which each term of an item lies within ``slop`` places of its offset.

    The lists of an item's rarest terms meet first; those of the others are read only for documents where they did.
    """
    terms = items.select("item_id", "ik", F.size("words").alias("n"), F.posexplode("words").alias("off", "word")).select("item_id", "ik", "n", "off", F.xxhash64("word").alias("term"))
    known = terms.join(index.terms.withColumnRenamed("n", "freq"), "term")
    ranked = materialize(known.withColumn("rank", F.row_number().over(Window.partitionBy("ik").orderBy("freq", "term", "off"))), "proximity")
    lists = lambda t: index.postings.join(small(t, t.count()), "term").select("id", "tx", "item_id", "ik", "n", "off", (F.col("pos") - F.col("off")).alias("shift"))
    within = Window.partitionBy("id", "tx", "ik").orderBy("shift").rangeBetween(0, slop)
    met = lambda rows, n: rows.withColumn("offs", F.size(F.collect_set("off").over(within))).where(F.col("offs") == n)
    anchors = met(lists(ranked.where(F.col("rank") <= rarest)), F.least(F.lit(rarest), F.col("n"))).select("id", "tx", "ik").distinct()
    rows = lists(ranked).alias("l").join(anchors.alias("a"), F.expr("l.id <=> a.id AND l.tx = a.tx AND l.ik = a.ik"), "left_semi")
    return met(rows, F.col("n")).select("id", "tx", "item_id", F.col("shift").alias("start")).distinct()


def _hits(words: Column, found: Column, window: int) -> Column:
    """For each item that aligns somewhere: its item_id and the word positions inside matching windows."""

    def one(c: Column) -> Column:
        size = F.least(F.lit(window), F.size(c["words"]))

        def at(shift: Column) -> Column:
            same = F.transform(c["words"], lambda w, i: F.coalesce(F.get(words, shift + i) == w, F.lit(False)))
            # where the words differ, with the ends of the item: between two such places lies a run of equal words
            breaks = F.concat(F.array(F.lit(-1)), F.filter(F.transform(same, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull()), F.array(F.size(c["words"])))
            runs = lambda b: F.transform(F.slice(b, 2, F.size(b) - 1), lambda e, k: F.struct((F.get(b, k) + 1).alias("lo"), e.alias("hi")))
            return F.flatten(F.transform(F.filter(let(breaks, runs), lambda r: r["hi"] - r["lo"] >= size), lambda r: F.sequence(shift + r["lo"], shift + r["hi"] - 1)))

        return F.struct(c["item_id"].alias("item_id"), F.flatten(F.transform(c["shifts"], at)).alias("at"))

    return F.filter(F.transform(F.coalesce(found, F.array()), one), lambda x: F.size(x["at"]) > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: id, text, ``keep`` columns, n_words, positions hit (sorted), item_ids (sorted), contaminated."""
    items = materialize(items_of(benchmark, item_id_col, item_text_col), "items")
    index = build_index(docs, items, id_col, text_col)
    met = alignments(index, items, window).groupBy("id", "tx", "ik").agg(F.collect_set("shift").alias("shifts"))
    met = met.join(_sent(items, F.octet_length(F.concat_ws(" ", "words"))), "ik")
    met = met.groupBy("id", "tx").agg(F.collect_list(F.struct("item_id", "shifts", "words")).alias("found"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))).withColumn("tx", F.xxhash64("text"))
    joined = rows.alias("d").join(met.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.tx") == F.col("m.tx")), "left").select("d.id", "d.text", *(f"d._k{i}" for i in range(len(keep))), "m.found")
    checked = let(alnum_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.col("found").isNotNull(), _hits(w, F.col("found"), window)).alias("hits")))
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    out = joined.select(F.col("id").alias(id_col), F.col("text").alias("text"), *kept, checked.alias("c"))
    hits = F.coalesce(F.col("c.hits"), F.array())
    positions = F.sort_array(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["at"]))))
    listed = F.sort_array(F.array_distinct(F.filter(F.transform(hits, lambda x: x["item_id"]), lambda i: i.isNotNull())))
    return out.select(id_col, "text", *keep, F.col("c.n_words").alias("n_words"), positions.alias("positions"), listed.alias("item_ids"), (F.size(hits) > 0).alias("contaminated"))
