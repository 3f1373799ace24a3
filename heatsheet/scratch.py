"""Intermediate tables in a folder that driver and executors share.

``settle`` cuts the lineage of a frame that several later steps read. It writes
Parquet instead of calling ``checkpoint()``: later steps then read only the
columns they need, and Spark knows the table's real size when it plans joins.
Nothing is lost with an executor, because the folder is shared storage.

The folder is the one in ``spark.checkpoint.dir``. A session without that setting
uses its warehouse, which driver and executors share as well.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes: dict[str, list[str]] = {}


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/heatsheet-{app}"


def shared_path(spark: SparkSession, kind: str = "") -> str:
    """A new path in the shared folder; the scope that is open removes it."""
    path = f"{_folder(spark)}/{kind}{uuid.uuid4().hex}"
    for paths in _scopes.get(spark.sparkContext.applicationId, [])[-1:]:
        paths.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def condense(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Settle the frame that ``build`` makes, and remove what was settled on the way to it."""
    path = shared_path(spark)
    with scope(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at its end, what was settled inside. Read the results before that."""
    open_scopes = _scopes.setdefault(spark.sparkContext.applicationId, [])
    open_scopes.append([])
    try:
        yield
    finally:
        for path in open_scopes.pop():
            _remove(spark, path)


def discard(spark: SparkSession) -> None:
    """Remove every table this application settled. Frames that read them become invalid."""
    _remove(spark, _folder(spark))
