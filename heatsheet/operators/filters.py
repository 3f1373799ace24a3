"""Row filters on the result fact."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup_figures


def latest_date(df: DataFrame) -> Column:
    """The newest date of a frame, as a scalar subquery."""
    return df.agg(F.max("date")).scalar()


def as_day(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def trailing(
    df: DataFrame, as_of: date | str | Column | None = None, months: int = 12
) -> DataFrame:
    """Rows of the last ``months`` up to ``as_of``, by default the frame's newest date."""
    end = latest_date(df) if as_of is None else as_day(as_of)
    return df.filter(F.col("date") >= F.add_months(end, -months))


def trailing_per_key(df: DataFrame, key: str, days: int) -> DataFrame:
    """Rows at most ``days`` older than the newest row of the same key."""
    newest = df.groupBy(key).agg(F.max("date").alias("__newest"))
    return (
        lookup_figures(df, newest, [key])
        .filter(F.date_diff("__newest", "date") <= days)
        .drop("__newest")
    )


def as_of_snapshot(df: DataFrame, months: int = 1) -> DataFrame:
    """Rows that already stood ``months`` before the frame's newest date."""
    return df.filter(F.col("date") <= F.add_months(latest_date(df), -months))


def having_count(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key occurs at least ``n`` times; a NULL key drops out."""
    frequent = df.groupBy(key).count().filter(F.col("count") >= n).select(key)
    return lookup_figures(df, frequent, [key], how="left_semi")


def for_competitor(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("name") == name)


def for_event(df: DataFrame, full_event: str) -> DataFrame:
    return df.filter(F.col("full_event") == full_event)


def for_competitors(df: DataFrame, names: Iterable[str] | DataFrame | None) -> DataFrame:
    """Rows of the listed competitors: a short list, or a frame with a ``name`` column.

    None keeps every named row.
    """
    if names is None:
        return df.filter(F.col("name").isNotNull())
    if isinstance(names, DataFrame):
        return df.join(names.select("name"), "name", "left_semi").select(*df.columns)
    names = list(dict.fromkeys(names))
    if len(names) < 2:
        raise ValueError("a comparison needs at least two names")
    return df.filter(F.col("name").isin(names))


def split_bad_names(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a name, and the sorted events that have rows without one."""
    bad_events = (
        df.filter(F.col("name").isNull() & F.col("full_event").isNotNull())
        .select("full_event")
        .distinct()
        .orderBy("full_event")
    )
    return df.filter(F.col("name").isNotNull()), bad_events


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct known values of a column."""
    return df.select(column).dropna().distinct().orderBy(column)
