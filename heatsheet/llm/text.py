"""Words, and the way texts reach Python tasks."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks are sent the functions themselves, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside.

    Executor and Python worker both hold a batch, the executor beside its heap; 10,000 rows of
    long texts, or of pairs of sets, take hundreds of MB in each task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_rows(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``rows`` gets an iterator over the input rows as tuples and yields output tuples.

    Both sides travel as Arrow batches. A task holds one batch at a time; ``df`` should
    carry texts as binary so that no byte is lost to decoding.
    """
    out = _arrow_schema(df, schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for row in rows(_tuples(source)):
            made.append(row)
            if len(made) >= OUT_ROWS:
                yield _batch(made, out)
                made = []
        if made:
            yield _batch(made, out)

    return df.mapInArrow(batches, schema)


def map_columns(df: DataFrame, columns: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """As ``map_rows``, but ``columns`` yields tuples of whole columns, as numpy arrays or lists."""
    out = _arrow_schema(df, schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in columns(_tuples(source)):
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, out.types, strict=True)], schema=out)

    return df.mapInArrow(batches, schema)


def _tuples(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in source:
        # slices bound what exists as Python objects at a time
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def chunks(source: Iterator[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows in lists whose texts, which come last, have ``size`` bytes together; a longer text is alone."""
    held, total = [], 0
    for row in source:
        held.append(row)
        total += len(row[-1] or b"")
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


SLICE_ROWS = 256
OUT_ROWS = 2048


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
    )


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def text_bytes(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns, then the text as bytes; null stays null."""
    return df.select(*columns, F.col("text").cast("binary").alias("text"))
