"""Totals, growth and the most frequent competitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, measures
from ..operators.filters import latest_date
from ..operators.timeline import cumulative
from ..settings import TOP_ROWS


def totals(df: DataFrame) -> DataFrame:
    """Distinct events and competitors, rows, time and pieces: one row."""
    return df.agg(
        F.count_distinct("full_event").alias("events"),
        F.count_distinct("name").alias("competitors"),
        F.count(F.lit(1)).alias("attempts"),
        F.coalesce(measures.exact_sum(F.col("seconds")), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.sum("pieces"), F.lit(0.0)).alias("pieces"),
    ).withColumn("seconds_text", clock.format_timedelta(F.col("seconds")))


def totals_delta(df: DataFrame, months: int = 1) -> DataFrame:
    """The totals, as they stood ``months`` before the newest date, and the growth since.

    Grouping by event, by name and by nothing in one pass: an event or a name stood there
    if its first date lies before the cutoff.
    """
    cutoff = F.add_months(latest_date(df), -months)
    keyed = df.select("full_event", "name", "date", "seconds", "pieces").withColumn(
        "__before", F.coalesce(F.col("date") <= cutoff, F.lit(False))
    )
    groups = keyed.groupingSets([["full_event"], ["name"], []], "full_event", "name").agg(
        F.grouping_id().alias("__set"),
        F.max("__before").alias("__stood"),
        F.count(F.lit(1)).alias("__rows"),
        F.count_if("__before").alias("__rows_before"),
        measures.exact_sum(F.col("seconds")).alias("__seconds"),
        measures.exact_sum(F.when(F.col("__before"), F.col("seconds"))).alias("__seconds_before"),
        F.sum("pieces").alias("__pieces"),
        F.sum(F.when(F.col("__before"), F.col("pieces"))).alias("__pieces_before"),
    )
    # The id has one bit per column, set where the column is not grouped by.
    is_event = (F.col("__set") == 1) & F.col("full_event").isNotNull()
    is_name = (F.col("__set") == 2) & F.col("name").isNotNull()
    is_all = F.col("__set") == 3

    def whole(column: str, zero) -> object:
        return F.coalesce(F.max(F.when(is_all, F.col(column))), F.lit(zero))

    both = groups.agg(
        F.count_if(is_event).alias("events"),
        F.count_if(is_event & F.col("__stood")).alias("events_before"),
        F.count_if(is_name).alias("competitors"),
        F.count_if(is_name & F.col("__stood")).alias("competitors_before"),
        whole("__rows", 0).alias("attempts"),
        whole("__rows_before", 0).alias("attempts_before"),
        whole("__seconds", 0.0).alias("seconds"),
        whole("__seconds_before", 0.0).alias("seconds_before"),
        whole("__pieces", 0.0).alias("pieces"),
        whole("__pieces_before", 0.0).alias("pieces_before"),
    )
    figures = ["events", "competitors", "attempts", "seconds", "pieces"]
    growth = [(F.col(c) - F.col(f"{c}_before")).alias(f"{c}_delta") for c in figures]
    return both.select("*", *growth).withColumns(
        {
            "seconds_text": clock.format_timedelta(F.col("seconds")),
            "seconds_delta_text": clock.format_timedelta(F.col("seconds_delta")),
        }
    )


def cumulative_competitors(df: DataFrame) -> DataFrame:
    """Competitors seen so far, by date of first appearance; nameless rows count as one."""
    return cumulative(_first_dates(df, "name"), "competitors")


def cumulative_events(df: DataFrame) -> DataFrame:
    """Events held so far, by first date."""
    return cumulative(_first_dates(df, "full_event"), "events")


def _first_dates(df: DataFrame, key: str) -> DataFrame:
    dated = df.filter(F.col("date").isNotNull())
    return dated.groupBy(key).agg(F.min("date").alias("date"))


def cumulative_entries(df: DataFrame) -> DataFrame:
    """Attempts logged so far."""
    return cumulative(df.filter(F.col("date").isNotNull()), "attempts")


def most_frequent(df: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """The ``n`` competitors with most attempts."""
    counts = df.filter(F.col("name").isNotNull()).groupBy("name")
    return (
        counts.agg(F.count(F.lit(1)).alias("attempts"))
        .orderBy(F.col("attempts").desc(), "name")
        .limit(n)
    )
