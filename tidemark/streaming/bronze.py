"""The raw layer as a stream: append every record with its lineage, validate and deduplicate afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """One topic from its beginning; lost data is an error (needs the connector package)."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("failOnDataLoss", "true").load()


def file_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int | None = 64) -> DataFrame:
    """Parquet files as they arrive. A path is a folder or a pattern; a pattern may name single files.

    Files are read in no order of event time: behind a watermark, a finished table needs None (all files in one batch), else
    the watermark of the first files discards the older events of later ones.
    """
    stream = spark.readStream.schema(schema)
    return (stream if files_per_batch is None else stream.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def bronze(log: DataFrame) -> DataFrame:
    """A log (topic, partition, offset, timestamp, key, value) as the eight raw columns."""
    return log.select(
        F.col("topic").cast("string").alias("kafka_topic"),
        F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").cast("bigint").alias("kafka_offset"),
        F.col("timestamp").cast("timestamp").alias("kafka_timestamp"),
        F.col("key").cast("string").alias("kafka_key"),
        F.col("value").cast("string").alias("raw_value"),
        F.current_timestamp().alias("bronze_ingested_at"),
        F.sha2(F.col("value").cast("string"), 256).alias("payload_sha256"),
    )


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, exactly once, then stop."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[tuple[int, int]]:
    """Id and input rows of the batches that had rows, as far back as the session keeps progress; the query has ended."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
