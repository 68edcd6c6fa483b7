"""Sources and sinks: scans with enforced schemas, line and CSV files, logs, and the fixed-order outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaMismatch(ValueError):
    """A table lacks columns or has them with other types."""


def check_schema(df: DataFrame, expected: str | T.StructType, exact: bool = False) -> DataFrame:
    """``df`` if it has the expected columns and types (and, if exact, no other columns)."""
    want = expected if isinstance(expected, T.StructType) else T.StructType.fromDDL(expected)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    missing = [f.name for f in want if f.name not in have]
    wrong = [f"{f.name}: {have[f.name]} is not {f.dataType.simpleString()}" for f in want if f.name in have and have[f.name] != f.dataType.simpleString()]
    more = sorted(set(have) - {f.name for f in want}) if exact else []
    if missing or wrong or more:
        raise SchemaMismatch(f"missing {missing}, wrong {wrong}, unexpected {more}")
    return df


def read_snapshot(spark: SparkSession, path: str, expected: str, exact: bool = False) -> DataFrame:
    return check_schema(spark.read.parquet(path), expected, exact)


def read_json_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Part files of JSON lines; any line that is no object of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "part-*.json").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines as ``raw_value``, for a contract to judge."""
    return spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "raw_value")


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, columns: Sequence[str] | None = None, forbidden: Sequence[str] = ()) -> DataFrame:
    """CSV with a header under an enforced schema; files whose name is forbidden are refused."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if p.rstrip("/").rsplit("/", 1)[-1] in forbidden:
            raise ValueError(f"{p} must not be read")
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(paths)
    return df.select(*columns) if columns else df


def read_documents(spark: SparkSession, path: str, schema: str, unique: str) -> DataFrame:
    """A JSON array of documents whose ids must be unique."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    if not df.groupBy(unique).count().where("count > 1").isEmpty():
        raise ValueError(f"{unique} repeats")
    return df


def read_query(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], **arguments: object) -> DataFrame:
    """A parameterised read query over given tables; values never become SQL text."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=arguments)


def in_memory(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def catalogue_columns(spark: SparkSession, table: str) -> list[tuple[str, str, bool]]:
    return [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)]


def read_log(spark: SparkSession, servers: str, topic: str, first: str = "earliest", last: str = "latest") -> DataFrame:
    """A bounded batch of a Kafka topic (needs the connector package)."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", first).option("endingOffsets", last).load()


def write_log(df: DataFrame, servers: str, topic: str, key: str) -> None:
    """Rows as JSON, keyed so that one entity stays in one partition."""
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_snapshots(outputs: Mapping[str, tuple[DataFrame, str]], holds: bool) -> None:
    """Overwrite every output, or none if the accounts do not hold."""
    if not holds:
        raise ValueError("invariants do not hold; nothing is written")
    for df, path in outputs.values():
        df.write.mode("overwrite").parquet(path)


def write_json_ordered(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_single_jsonl(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One file of compact JSON lines in a fixed order; for exports small enough for one task."""
    df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
