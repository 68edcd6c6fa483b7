"""Order checks of per-entity sequences, and lexical retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import once


def sequence_gaps(rows: DataFrame, entity: str, number: str, first: int = 1) -> DataFrame:
    """Per entity: rows, and rows whose number is not the next one."""
    w = Window.partitionBy(entity).orderBy(number)
    marked = rows.select(entity, (F.row_number().over(w) - 1 + first != F.col(number)).alias("off"))
    return marked.groupBy(entity).agg(F.count("*").alias("n"), F.count_if("off").alias("out_of_sequence"))


def order_violations(rows: DataFrame, entity: str, arrival: Sequence[str], rising: str) -> DataFrame:
    """Per entity: rows whose value is below that of the row that arrived before."""
    w = Window.partitionBy(entity).orderBy(*arrival)
    marked = rows.select(entity, (F.col(rising) < F.lag(rising).over(w)).alias("down"))
    return marked.groupBy(entity).agg(F.count_if(F.coalesce("down", F.lit(False))).alias("violations"))


def irregularities(rows: DataFrame, entity: str, arrival: Sequence[str], number: str, time: str, interval_s: float, rising: str) -> DataFrame:
    """Per entity, in order of arrival: rows whose number is not 1, 2, .., whose time is not the first row's plus so many intervals, and whose value falls.

    A missing number or time is irregular; a missing value is not, and the one after it is compared with nothing.
    """
    w = Window.partitionBy(entity).orderBy(*arrival)
    place = F.row_number().over(w) - 1
    at = F.unix_micros(F.col(time).cast("timestamp"))
    off = at - F.first(at).over(w) - place.cast("bigint") * F.lit(round(interval_s * 1_000_000)).cast("bigint")
    marked = rows.select(entity, F.col(number).eqNullSafe(place + 1).alias("next"), (off == 0).alias("timely"), (F.col(rising) < F.lag(rising).over(w)).alias("down"))
    missed = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    return marked.groupBy(entity).agg(F.count("*").alias("n"), missed("next").alias("out_of_sequence"), missed("timely").alias("off_schedule"), F.count_if("down").alias("falls"))


def partition_inconsistencies(rows: DataFrame, entity: str, partition: str) -> DataFrame:
    return rows.groupBy(entity).agg(F.count_distinct(partition).alias("partitions")).where("partitions > 1")


# Words that say nothing about a question.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "is", "it", "of", "on", "or", "the", "to", "what", "with")


def _found(query: Column, text: str) -> Column:
    """The query's tokens that a text holds."""
    return F.array_intersect(query, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))


def retrieve(docs: DataFrame, query: Sequence[str], title: str, content: str, key: str, k: int, boost: float = 1.5) -> DataFrame:
    """Top-k by |query in title or content| + boost * |query in title|; zero scores are no results, stop words do not count.

    Only the query's few tokens are kept of each text. The zero filter stands after the top-k, which it cannot
    change, so that texts are not scored once more for it.
    """
    words = [w for w in dict.fromkeys(query) if w not in STOPWORDS]
    q = F.array(*map(F.lit, words)).cast("array<string>")
    score = once(F.struct(_found(q, title).alias("t"), _found(q, content).alias("c")), lambda h: F.size(F.array_union(h["t"], h["c"])) + boost * F.size(h["t"]))
    return docs.select(key, score.cast("double").alias("score")).orderBy(F.col("score").desc(), key).limit(k).where("score > 0")
