"""The ranking: event z-scores, event percentiles and external ratings combined."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import as_day, trailing
from ..operators.joins import lookup_figures
from ..operators.ordering import (
    by_size,
    group_sizes,
    quantiles,
    rank_by_window,
    row_mean,
    with_position,
    with_rank,
)
from ..settings import ONE_TASK_ROWS, RANK_PLACES
from ..scratch import settle


def event_stats(
    df: DataFrame,
    key: str = "event",
    value: str = "corrected_time",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Mean, sample deviation, count, median and interquartile range per event.

    ``sd_used`` and ``iqr_used`` are 1 where the figure is missing or zero. Quartiles are
    exact.
    """
    known = df.filter(F.col(key).isNotNull())
    basic = {"mean": F.avg(value), "sd": F.stddev_samp(value), "timed": F.count(value)}
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    figures = quantiles(known, value, wanted, [key], one_task_rows, beside=basic)
    iqr = F.col("q3") - F.col("q1")
    return figures.select(
        key,
        "mean",
        "sd",
        "timed",
        "median",
        iqr.alias("iqr"),
        _usable_deviation(F.col("timed"), F.col("sd")).alias("sd_used"),
        F.when(iqr.isNull() | (iqr == 0), 1.0).otherwise(iqr).alias("iqr_used"),
    )


def _usable_deviation(timed: Column, sd: Column) -> Column:
    return F.when((timed == 1) | (sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)


def score_attempts(
    df: DataFrame,
    key: str = "event",
    value: str = "corrected_time",
    min_event_attempts: int = 1,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add each attempt's z-score (higher is better) and percentile inside its event.

    Keeps events with at least ``min_event_attempts`` rows, and adds ``event_timed``, the
    number of timed rows. An attempt without a time stays, without scores.
    """
    known = df.filter(F.col(key).isNotNull())

    def small(rows):
        return _score_by_window(rows, key, value)

    def large(rows, crowd):
        return _score_by_values(rows, key, value, crowd, one_task_rows)

    scored = by_size(known, [key], one_task_rows, None, small, large)
    return scored.filter(F.col("__attempts") >= min_event_attempts).drop("__attempts")


def _z(value: str, mean: Column, sd: Column, timed: Column) -> Column:
    return -(F.col(value) - mean) / _usable_deviation(timed, sd)


def _score_by_window(rows, key, value):
    # The rank comes first: its sort by (event, value) then serves the other windows too.
    ranked = rank_by_window(rows, "percentile", value, [key], "percent")
    event = Window.partitionBy(key)
    timed = F.count(value).over(event)
    return ranked.withColumns(
        {
            "__attempts": F.count(F.lit(1)).over(event),
            "event_timed": timed,
            "z": _z(value, F.avg(value).over(event), F.stddev_samp(value).over(event), timed),
        }
    )


def _score_by_values(rows, key, value, sizes, one_task_rows):
    ranked = with_rank(
        rows, "percentile", value, [key], "percent", one_task_rows=one_task_rows, sizes=sizes
    )
    stats = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("__attempts"),
        F.count(value).alias("event_timed"),
        F.avg(value).alias("__mean"),
        F.stddev_samp(value).alias("__sd"),
    )
    z = _z(value, F.col("__mean"), F.col("__sd"), F.col("event_timed"))
    return lookup_figures(ranked, stats, [key]).withColumn("z", z).drop("__mean", "__sd")


def rankings(
    df: DataFrame,
    as_of: date | str | Column | None = None,
    min_attempts: int = 10,
    min_event_attempts: int = 1,
    weighted: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Rank competitors by the mean of several ranks over the year up to ``as_of``.

    ``as_of`` is today unless given. A competitor needs ``min_attempts`` rows in events of
    at least ``min_event_attempts`` rows. ``weighted`` adds ranks that weigh each attempt
    by the number of timed rows in its event. A name that stands for several (total, latest
    rating) pairs has one row per pair, which shifts the rating ranks behind it.
    """
    today = F.current_date() if as_of is None else as_day(as_of)
    recent = trailing(df.select("event", "name", "date", "corrected_time"), today)
    scored = score_attempts(
        recent, min_event_attempts=min_event_attempts, one_task_rows=one_task_rows
    )
    people = settle(_competitor_means(scored, weighted).filter(F.col("attempts") >= min_attempts))
    sizes = group_sizes(people, [])

    def ranked(frame, out, value, descending=False):
        return with_rank(frame, out, value, [], "min", descending, one_task_rows, sizes)

    order = [F.col("mean_z").desc_nulls_last(), F.col("name")]
    people = with_position(people, "z_rank", order, [], one_task_rows, sizes)
    people = ranked(people, "percentile_rank", "mean_percentile")
    rank_columns = ["rating_rank", "z_rank", "percentile_rank"]
    if weighted:
        people = ranked(people, "weighted_z_rank", "weighted_z", descending=True)
        people = ranked(people, "weighted_percentile_rank", "weighted_percentile")
        rank_columns += ["weighted_z_rank", "weighted_percentile_rank"]

    pairs = df.select("name", "total_events", "latest_rating").distinct()
    # Every ranked name has a pair. An inner join may be split on either side, should one name
    # stand for very many people.
    listed = settle(lookup_figures(people, pairs, ["name"], how="inner"))
    sizes = group_sizes(listed, [])
    rating_order = [F.col("latest_rating").asc_nulls_last(), F.col("name"), F.col("total_events")]
    listed = with_position(listed, "rating_rank", rating_order, [], one_task_rows, sizes)
    listed = listed.withColumn("avg_rank", row_mean(*rank_columns))
    overall_order = [F.col("avg_rank"), F.col("name"), F.col("rating_rank")]
    listed = with_position(listed, "overall_rank", overall_order, [], one_task_rows, sizes)
    return listed.select(
        "name",
        F.col("attempts").alias("eligible_attempts"),
        *rank_columns,
        "avg_rank",
        "overall_rank",
    )


def _competitor_means(scored: DataFrame, weighted: bool) -> DataFrame:
    def rankable(column: Column) -> Column:
        return F.round(column, RANK_PLACES)

    means = {
        "attempts": F.count(F.lit(1)),
        "mean_z": rankable(F.avg("z")),
        "mean_percentile": rankable(F.avg("percentile")),
    }
    if weighted:
        # The weight of an untimed attempt counts, though it adds nothing above the line.
        weights = F.sum("event_timed")
        for out, score in (("weighted_z", "z"), ("weighted_percentile", "percentile")):
            total = F.coalesce(F.sum(F.col(score) * F.col("event_timed")), F.lit(0.0))
            means[out] = rankable(F.try_divide(total, weights))
    named = scored.filter(F.col("name").isNotNull())
    return named.groupBy("name").agg(*[e.alias(c) for c, e in means.items()])


def min_eligible(ranking: DataFrame) -> DataFrame:
    """The smallest number of attempts in a ranking."""
    return ranking.agg(F.min("eligible_attempts").alias("min_eligible"))


def rank_pairs(ranking: DataFrame) -> DataFrame:
    """Every two rank columns side by side, for rows that have both ranks."""
    columns = [c for c in ranking.columns if c.endswith("_rank") and c != "overall_rank"]
    pairs = [
        F.struct(
            F.lit(x).alias("x_col"),
            F.lit(y).alias("y_col"),
            F.col(x).cast("double").alias("x"),
            F.col(y).cast("double").alias("y"),
        )
        for i, x in enumerate(columns)
        for y in columns[i + 1:]
    ]
    paired = ranking.select("name", F.explode(F.array(*pairs)).alias("pair"))
    return (
        paired.select("pair.x_col", "pair.y_col", "name", "pair.x", "pair.y")
        .dropna(subset=["x", "y"])
    )


def rank_pair_bounds(ranking: DataFrame) -> DataFrame:
    """Ends of the 1:1 line in the overlap of the two columns of each pair."""
    return rank_pairs(ranking).groupBy("x_col", "y_col").agg(
        F.greatest(F.min("x"), F.min("y")).alias("low"),
        F.least(F.max("x"), F.max("y")).alias("high"),
    )
