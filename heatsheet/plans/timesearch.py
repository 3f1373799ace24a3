"""Search for competitors by their recent pace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import parse_hms_lenient


def latest_state(df: DataFrame) -> DataFrame:
    """Per competitor the newest known value of each column, taken column by column.

    Undated rows count as oldest; on one day the first entry wins.
    """
    place = F.struct(F.col("date").isNull(), -F.unix_date("date"), "entry_id")

    def newest(column: str):
        known = F.when(F.col(column).isNotNull(), place)
        return F.min_by(column, known).alias(column)

    columns = ["full_event", "total_events", "avg_12m_text"]
    named = df.filter(F.col("name").isNotNull())
    return named.groupBy("name").agg(F.max("date").alias("date"), *[newest(c) for c in columns])


def _with_pace(df: DataFrame) -> DataFrame:
    pace = parse_hms_lenient(F.col("avg_12m_text"))
    return latest_state(df).withColumn("pace_seconds", pace)


def _in_range(lo: int | None, hi: int | None):
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (F.col("pace_seconds") >= lo)
    if hi is not None:
        inside = inside & (F.col("pace_seconds") <= hi)
    return inside


def time_search(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Competitors whose 12-month average lies in a range of seconds, fastest first.

    Without ``lo`` or ``hi`` the range is open at that end. A missing average counts as 0.
    """
    found = _with_pace(df).filter(_in_range(lo, hi))
    return found.select(
        "name", "avg_12m_text", "total_events", "full_event", "date", "pace_seconds"
    ).orderBy("pace_seconds", "name")


def time_search_counts(
    df: DataFrame, lo: int | None = None, hi: int | None = None
) -> DataFrame:
    """"Showing k of n", and the smallest average: one row."""
    return _with_pace(df).agg(
        F.count_if(_in_range(lo, hi)).alias("shown"),
        F.count(F.lit(1)).alias("competitors"),
        F.min("pace_seconds").alias("smallest"),
    )
