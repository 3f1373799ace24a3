"""Reading the source tables and the published tables, and writing the latter."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from math import ceil

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..scratch import shared_path
from ..settings import FULL_PIECES
from .files import current_path, list_folder, write_version

log = logging.getLogger(__name__)

#: Formats whose files end in a part that says what is in them.
_WITH_FOOTER = {"parquet", "orc"}


def list_tables(spark: SparkSession, base: str | None, layout: str = "{name}") -> list[str]:
    """Names of all tables in a folder, by ``layout``, or in the current catalog if ``base`` is None."""
    if base is None:
        return sorted(t.name for t in spark.catalog.listTables())
    before, after = layout.split("{name}")
    found = list_folder(spark, base)
    fitting = [n for n in found if n.startswith(before) and n.endswith(after) and len(n) > len(before + after)]
    return [n[len(before) : len(n) - len(after)] for n in fitting]


def load_tables(
    spark: SparkSession,
    base: str | None,
    names: Iterable[str] | None = None,
    optional: Iterable[str] = (),
    format: str = "parquet",
    layout: str = "{name}",
    **options: str,
) -> dict[str, DataFrame]:
    """Open tables by name, lazily; without names, all that ``list_tables`` finds.

    ``base`` is a folder holding one path per table, named by ``layout``, or None for
    catalog tables.
    CSV columns go by their header and stay text; the builders read numbers and dates.
    A table that cannot be opened fails at once, unless it is listed in ``optional``:
    then the problem is logged and an empty frame with the declared schema stands in, or
    nothing where no schema is declared, and the others go on. Of optional tables, and of all if
    none are named, the ends of all files are read once to see whether they are whole, as a
    broken file would fail only later, inside a query.
    """
    if names is None:
        optional = list_tables(spark, base, layout)
        names = []
    tables = {}
    for name in dict.fromkeys([*names, *optional]):
        try:
            table = _open(spark, base, name, format, layout, options)
            if name in set(optional) and base is not None:
                _probe(table, format)
            tables[name] = table
        except (PySparkException, Py4JError) as problem:
            if name not in set(optional):
                raise
            log.warning("optional table %s cannot be read: %s", name, _reason(problem))
            if name in S.SOURCES:
                tables[name] = spark.createDataFrame([], S.SOURCES[name])
    return tables


def _open(spark, base, name, format, layout, options):
    if base is None:
        return spark.table(name)
    if format == "csv":
        options = {"header": True, **options}
    reader = spark.read.format(format).options(**options)
    return reader.load(f"{base.rstrip('/')}/{layout.format(name=name)}")


def _probe(table: DataFrame, format: str) -> None:
    """Fail now if a file is broken: counting reads the ends of files alone, or else one row is read."""
    if format in _WITH_FOOTER:
        table.select().count()
    else:
        table.limit(1).collect()


def _reason(problem: Exception) -> str:
    condition = problem.getCondition() if isinstance(problem, PySparkException) else None
    return condition or str(problem).split("\n", 1)[0]


def bucket_sources(tables: dict[str, DataFrame], buckets: int, path: str | None = None) -> dict[str, DataFrame]:
    """Store the source tables for ``build_results``: entries and teams in buckets by entry, sorted.

    Both have the same buckets, so their join moves no row. An entry has few members, so no
    bucket can outgrow the others by a hot key; a competitor may have very many entries,
    so tables by competitor stay as they are, and Spark may split a skewed one when it
    joins. Other tables pass unchanged. The stored tables are catalog tables under a
    random name, with their files in ``path`` or the shared folder. As many tasks as the data
    asks for sort and write them, not one a bucket; the shuffle has a multiple of the buckets,
    so that one of its partitions has rows of one bucket alone.
    """
    out = dict(tables)
    for name in ("competition_entries", "entry_competitors"):
        table = tables[name]
        spark = table.sparkSession
        place = f"{path.rstrip('/')}/{name}" if path else shared_path(spark, "buckets-")
        stored = f"{name}_{place.rsplit('/', 1)[1].replace('-', '_')}" if path is None else f"{name}_bucketed"
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = [buckets * ceil(usual / buckets)] if usual % buckets else []  # without a number, small ones are merged
        (
            table.repartition(*spread, "entry_id").write.format("parquet").option("path", place)
            .bucketBy(buckets, "entry_id").sortBy("entry_id").mode("overwrite").saveAsTable(stored)
        )
        out[name] = spark.table(stored)
    return out


def load_results(spark: SparkSession, path: str, pieces: float | None = FULL_PIECES) -> DataFrame:
    """Open the result fact, keeping one size class and the rows of unknown size."""
    results = spark.read.parquet(current_path(spark, path))
    return results if pieces is None else size_class(results, pieces)


def size_class(results: DataFrame, pieces: float = FULL_PIECES) -> DataFrame:
    return results.filter((F.col("pieces") == pieces) | F.col("pieces").isNull())


def load_rankings(spark: SparkSession, path: str) -> DataFrame:
    """Open a ranking; one that lacks a column, or has one of another type, is refused."""
    ranking = spark.read.parquet(current_path(spark, path))
    kinds = dict(ranking.dtypes)
    wrong = [f.name for f in S.RANKINGS.fields if kinds.get(f.name) not in _alike(f.dataType.simpleString())]
    if wrong:
        raise ValueError(f"no ranking: {', '.join(wrong)} missing or of another type")
    return ranking


def _alike(kind: str) -> set[str]:
    return {"bigint", "int"} if kind == "bigint" else {kind}


def write_results(df: DataFrame, path: str, cluster_by: Iterable[str] = ()) -> None:
    """Replace the fact as a whole. ``cluster_by``, say date and entry_id, keeps close values in
    one file, so that a reader of the last year skips the other files."""
    if keys := list(cluster_by):
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    write_version(df.sparkSession, path, df.write.parquet)


def write_results_csv(df: DataFrame, path: str) -> None:
    """Replace the fact as text with a header; ``current_path`` names the folder to read."""
    write_version(df.sparkSession, path, df.write.option("header", True).csv)


def load_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """The fact as ``write_results_csv`` left it; ids are text."""
    return S.conform(spark.read.option("header", True).csv(current_path(spark, path)), S.RESULTS)


def write_rankings(df: DataFrame, path: str) -> None:
    write_version(df.sparkSession, path, df.write.parquet)
