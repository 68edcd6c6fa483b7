"""From raw documents to token ids in five stages, each an operator of ``tidemark.llm``.

A stage takes the documents that the one before it kept. Toxic documents, all but one of each group of
near duplicates, and documents that hold benchmark passages go; secrets are replaced by a mark; the rest
is encoded. Each stage's rows are written as Parquet and read again, and what it needed besides is deleted.

Defined results: a null text is empty (clean, linked with nothing, without tokens); rows of one doc_id are one document,
rows of a null doc_id are documents of their own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, minhash, secrets, toxicity
from tidemark.llm.storage import cleared, fresh_path, materialize


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text in one, so that none can clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return rows.select(*(changed.get(c, F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.score(_packed(docs), model, keep=("row",)).where("score < 0.5"), docs)


def _one_row_each(docs: DataFrame) -> DataFrame:
    """Rows of one doc_id are one document: of several the least by a hash of the text, then by all columns, stays. Rows without id are not compared."""
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("row")))
    first = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(least.alias("least"))
    return docs.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(first.select("least.row.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _one_row_each(docs)
    found = minhash.near_duplicates(docs)
    return docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("row",))
    return _unpacked(found.where("NOT contaminated"), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = secrets.BlobLedger(fresh_path(spark, "ledger"))
    found = ledger.scan(_packed(docs), keep=("text", "row"))
    # a column of its own first: a length worked out beside an alias "text" would be that of the alias redacted again
    found = found.withColumn("clean", secrets.redact(F.col("text"), F.col("spans")))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.char_length("clean")).otherwise(F.col("row.n_chars")).cast("bigint")
    return _unpacked(found, docs, **changed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe", encode),
]

#: The trained and hashed stages have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
