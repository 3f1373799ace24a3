"""Several competitors side by side. ``names=None`` compares everybody."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, measures
from ..operators.filters import for_competitors, latest_date
from ..operators.joins import lookup
from ..operators.ordering import with_position
from ..settings import ONE_TASK_ROWS
from .profiles import _HISTORY, with_entrants

Names = Iterable[str] | DataFrame | None


def compare_summary(df: DataFrame, names: Names, ranking: DataFrame) -> DataFrame:
    """Means over all rows and over the last year, with the overall rank.

    The last year ends with the newest date among the compared competitors. Rows are
    sorted by the shown last-year time; who has none comes first, with a dash.
    """
    rows = for_competitors(df.select("name", "date", "seconds", "ppm"), names)
    recent = F.col("date") >= F.add_months(latest_date(rows), -12)

    def last_year(column: str):
        return F.when(F.col("__recent"), F.col(column))

    means = rows.withColumn("__recent", recent).groupBy("name").agg(
        F.count(F.lit(1)).alias("events"),
        measures.exact_mean(F.col("seconds")).alias("avg_seconds"),
        F.avg("ppm").alias("avg_ppm"),
        F.count_if("__recent").alias("last_year_events"),
        measures.exact_mean(last_year("seconds")).alias("last_year_seconds"),
        F.avg(last_year("ppm")).alias("last_year_ppm"),
    )
    ranked = lookup(means, ranking.select("name", F.col("overall_rank").alias("rank")), ["name"])
    summary = ranked.select(
        "name",
        "rank",
        "events",
        clock.format_hms(F.col("avg_seconds")).alias("average_time"),
        measures.round_or_dash(F.col("avg_ppm")).alias("average_ppm"),
        "last_year_events",
        clock.format_hms_or_dash(F.col("last_year_seconds")).alias("last_year_time"),
        measures.round_or_dash(F.col("last_year_ppm")).alias("last_year_average_ppm"),
        "avg_seconds",
        "avg_ppm",
        "last_year_seconds",
        "last_year_ppm",
        clock.hours(F.col("last_year_seconds")).alias("last_year_hours"),
    )
    return summary.orderBy("last_year_time", "name", "rank")


def compare_bars(summary: DataFrame) -> DataFrame:
    """The bars of a comparison: competitors with times in the last year, fastest first."""
    return (
        summary.dropna(subset=["last_year_seconds"])
        .select("name", "last_year_hours", "last_year_time", "last_year_ppm", "last_year_events",
                "last_year_seconds")
        .orderBy("last_year_seconds", "name")
    )


def rating_series(df: DataFrame, names: Names) -> DataFrame:
    """Ratings after each event, by date."""
    rated = for_competitors(df, names).dropna(subset=["name", "date", "rating_out"])
    return rated.select("name", "date", "rating_out", "entry_id").orderBy("date", "entry_id")


def ordered_attempts(
    df: DataFrame, names: Names, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """All attempts fastest first, labelled ``name i`` with i from 0; untimed ones last."""
    rows = for_competitors(df, names).select("name", "entry_id", "full_event", "seconds")
    order = [F.col("seconds").asc_nulls_last(), F.col("entry_id")]
    placed = with_position(rows, "__place", order, [], one_task_rows)
    label = F.concat_ws(" ", F.col("name"), (F.col("__place") - 1).cast("string"))
    return placed.select(
        label.alias("label"),
        "name",
        "entry_id",
        "full_event",
        "seconds",
        clock.hours(F.col("seconds")).alias("hours"),
        clock.format_hms(F.col("seconds")).alias("time_hms"),
    )


def compare_history(df: DataFrame, names: Names) -> DataFrame:
    """All attempts with the rank as "N/T", by name and date, both descending."""
    rows = with_entrants(for_competitors(df, names), df).select(
        "name",
        "entry_id",
        "date",
        "full_event",
        measures.rank_of_total(F.col("rank"), F.col("entries")).alias("rank_text"),
        *_HISTORY,
    )
    return rows.orderBy(F.col("name").desc(), F.col("date").desc_nulls_last(), "entry_id")
