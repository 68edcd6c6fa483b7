"""Intermediate tables: always in the folder that driver and executors share.

That is ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder of this machine; on a cluster,
whose executors could not read that, an error is raised. Tables stay until ``cleared`` or the owner of the folder
removes them, as a lazy result may still read them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set(_KEY, base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read back, so that their lineage ends at files that outlive executors."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def kept(spark: SparkSession, name: str, rows: Callable[[], list], schema: str) -> DataFrame:
    """A small table that is worked out once and found again by its name. Two that write it at once leave one whole table."""
    path = f"{shared_dir(spark)}/kept/{name}"
    if not exists(spark, path):
        own = fresh_path(spark, "kept")
        spark.createDataFrame(rows(), schema).coalesce(1).write.parquet(own)
        where, files = _at(spark, path)
        files.mkdirs(where.getParent())
        if exists(spark, path) or not files.rename(_at(spark, own)[0], where):
            path = path if exists(spark, path) else own
    return spark.read.schema(schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Delete the tables that the block made, but for ``keep``, once it has ended well; what it returns must be written by then."""
    before = len(_made)
    yield
    for path in _made[before:]:
        if path not in keep:
            where, files = _at(spark, path)
            files.delete(where, True)
    _made[before:] = [p for p in _made[before:] if p in keep]
