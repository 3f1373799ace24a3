"""Folders: what is in them, and tables that are replaced as a whole.

A table is written to a folder of its own beside the last one, and then a pointer, a file of
one line, is switched to it. A reader meets the old table or the new one, never half of one, and a
run that fails leaves the old one. Some older versions stay for readers that still use them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "_current"
#: Versions that stay beside the current one.
KEPT_VERSIONS = 1
_VERSION = re.compile(r"v-\d{8}-[0-9a-f]{8}")


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system, which may be any that Spark can use."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; hidden ones, which begin with . or _, are left out."""
    at, files = _hadoop(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(at)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of a table's current version; ``path`` itself if it has no versions."""
    at, files = _hadoop(spark, f"{path.rstrip('/')}/{POINTER}")
    if not files.exists(at):
        return path
    stream = files.open(at)
    try:
        name = bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{name}"


def write_version(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Have ``write`` fill a new folder below ``path``, then make that the current version."""
    base = path.rstrip("/")
    before = current_path(spark, base)
    number = int(before.rsplit("/v-", 1)[1][:8]) + 1 if before != base else 1
    name = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
    try:
        write(f"{base}/{name}")
        _point(spark, base, name)
    except BaseException:
        at, files = _hadoop(spark, f"{base}/{name}")
        files.delete(at, True)
        raise
    _remove_old(spark, base, name)
    return f"{base}/{name}"


def _point(spark: SparkSession, base: str, name: str) -> None:
    """Switch the pointer by a rename, which file systems do at once."""
    fresh, files = _hadoop(spark, f"{base}/_next-{name}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}")
    # the rename of FileContext may replace a file, the older one may not
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(files.makeQualified(fresh), files.makeQualified(at), options)


def _remove_old(spark: SparkSession, base: str, name: str) -> None:
    older = [n for n in list_folder(spark, base) if _VERSION.fullmatch(n) and n < name]
    for old in older[: max(0, len(older) - KEPT_VERSIONS)]:
        at, files = _hadoop(spark, f"{base}/{old}")
        files.delete(at, True)
