"""Reading a workbook kept as one file per event sheet."""

from __future__ import annotations

import csv
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import lookup_figures


def union_sources(
    spark: SparkSession,
    paths: Iterable[str],
    exclude: Iterable[str] = (),
    format: str = "csv",
    named_by: str = "file",
    **options: str,
) -> DataFrame:
    """Union event sheets by column name, skipping utility sheets.

    A sheet's name is its file name without the ending, or with ``named_by="folder"`` the name
    of the folder that holds its files; it goes to ``source``. Sheets may have different
    columns; a missing one is NULL. ``row_no`` orders the rows of a sheet as they stand in
    the file: by file and block, and by position inside the block.

    The first lines of all CSV files are read by one job, and sheets of equal layout by one
    scan, so jobs and plan grow with the number of layouts, not of sheets. A header must
    not run over several lines.
    """
    skipped = set(exclude)
    kept = [path for path in paths if PurePosixPath(path).stem not in skipped]
    if not kept:
        raise ValueError("no event sheets to read")
    if format != "csv":
        # these formats merge layouts by themselves
        merged = spark.read.format(format).options(**{"mergeSchema": True, **options})
        return _with_position(merged.load(kept), named_by)
    options = {"header": True, **options}
    layouts = defaultdict(list)
    for path, header in _first_lines(spark, kept, options).items():
        layouts[header].append(path)
    if not layouts:  # no sheet has a line
        return _with_position(spark.read.schema("event string").csv(kept[0]), named_by)
    scans = []
    for header, same in sorted(layouts.items()):
        reader = spark.read.options(**options).schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
        scans.append(_with_position(reader.csv(sorted(same)), named_by))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _first_lines(spark: SparkSession, paths: list[str], options: dict) -> dict[str, tuple[str, ...]]:
    """Columns of each file that has a line, from one job over all files; a row per file reaches the driver."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value",
    )
    firsts = lines.groupBy("path").agg(F.min_by("value", "at").alias("header")).collect()
    separator, quote = options.get("sep", options.get("delimiter", ",")), options.get("quote", '"')
    return {_plain(row["path"]): _columns(row["header"], separator, quote) for row in firsts}


def _plain(path: str) -> str:
    """A path as readers take it, from one written as a URI."""
    return unquote(path)


def _columns(header: str, separator: str, quote: str) -> tuple[str, ...]:
    """Names in a header line; unnamed columns are named by place, repeated names get theirs added."""
    names = next(csv.reader([header.removeprefix("\ufeff")], delimiter=separator, quotechar=quote or None))
    plain = Counter(name.lower() for name in names)
    return tuple(
        f"_c{i}" if not name else f"{name}{i}" if plain[name.lower()] > 1 else name for i, name in enumerate(names)
    )


def _with_position(sheets: DataFrame, named_by: str) -> DataFrame:
    return sheets.select(
        "*",
        _sheet_name(named_by).alias("source"),
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("row_no"),
    )


def _sheet_name(named_by: str) -> Column:
    # The metadata column holds the path as a URI, where a plus is just a plus.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    if named_by == "folder":
        return F.element_at(F.split(path, "/"), -2)
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def tag_source(
    df: DataFrame,
    source_col: str = "source",
    title_col: str = "event",
    order_col: str = "row_no",
) -> DataFrame:
    """Give each row its source's title, which stands in the source's first row.

    Afterwards ``event`` is the source name and ``full_event`` the title.
    """
    titles = df.groupBy(source_col).agg(F.min_by(title_col, order_col).alias("full_event"))
    tagged = lookup_figures(df.drop("full_event"), titles, [source_col])
    return tagged.withColumn("event", F.col(source_col))


def drop_if_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)
