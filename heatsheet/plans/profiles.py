"""One competitor, or every competitor at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, measures
from ..operators.filters import for_competitor, split_bad_names, trailing_per_key
from ..operators.joins import lookup, lookup_figures
from ..operators.ordering import with_percent_ranks
from ..operators.timeline import timeline
from ..settings import ONE_TASK_ROWS, SERIES_DAYS
from ..scratch import settle


def _named(df: DataFrame, name: str | None = None) -> DataFrame:
    good, _ = split_bad_names(df)
    return good if name is None else for_competitor(good, name)


def medals(df: DataFrame, name: str | None = None) -> DataFrame:
    """First, second and third places per competitor, over dated rows."""
    return _figures(_dated(_named(df, name))).select("name", *_PLACES)


def competitor_stats(df: DataFrame, name: str | None = None) -> DataFrame:
    """Events, pieces, fastest and mean time per competitor, over dated rows."""
    return _figures(_dated(_named(df, name))).select("name", *_STATS)


_PLACES = {"gold": 1, "silver": 2, "bronze": 3}
_STATS = ["events", "pieces", "fastest", "average"]


def _dated(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("date").isNotNull())


def _figures(rows: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Figures per competitor, for the rows under each condition, in one pass.

    The columns of a condition begin with its name. Rows are summed per (name, event) first:
    distinct events become a plain count, and many tasks share a competitor with very many
    rows.
    """
    conditions = conditions or {"": F.lit(True)}
    per_event, per_name = [], []
    for prefix, condition in conditions.items():
        def under(column, condition=condition):
            return F.when(condition, F.col(column))

        def named(column, prefix=prefix):
            return f"{prefix}{column}"

        per_event += [
            F.count_if(condition).alias(named("rows")),
            F.sum(under("pieces")).alias(named("pieces")),
            F.min(under("seconds")).alias(named("fastest")),
            F.sum(measures.micros(under("seconds"))).alias(named("micros")),
            F.count(under("seconds")).alias(named("timed")),
            *[
                F.count_if(condition & (F.col("rank") == place)).alias(named(medal))
                for medal, place in _PLACES.items()
            ],
        ]
        present = F.col("full_event").isNotNull() & (F.col(named("rows")) > 0)
        seconds = measures.exact_total(F.col(named("micros")))
        per_name += [
            F.count_if(present).alias(named("events")),
            F.coalesce(F.sum(named("pieces")), F.lit(0.0)).alias(named("pieces")),
            F.min(named("fastest")).alias(named("fastest")),
            F.try_divide(seconds, F.sum(named("timed"))).alias(named("average")),
            F.sum(named("rows")).alias(named("rows")),
            *[F.sum(named(medal)).alias(named(medal)) for medal in _PLACES],
        ]
    return rows.groupBy("name", "full_event").agg(*per_event).groupBy("name").agg(*per_name)


def population_pct(
    df: DataFrame, columns: list[str], one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Add ``<column>_pct``: the percentile of each row's value among all rows."""
    return with_percent_ranks(settle(df), {c: f"{c}_pct" for c in columns}, one_task_rows)


def competitor_profile(
    df: DataFrame,
    ranking: DataFrame,
    name: str | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Medals, figures, population percentiles and rank of competitors.

    Shown figures count dated rows only, percentiles compare all rows. Time percentiles
    are turned round, so that a higher one is better. Unranked competitors have NULL ranks.
    """
    figures = _figures(
        _named(df), {"": F.col("date").isNotNull(), "all_": F.lit(True)}
    )
    compared = population_pct(figures, [f"all_{c}" for c in _STATS], one_task_rows)
    shown = compared.filter(F.col("rows") > 0).select(
        "name",
        *_STATS,
        *_PLACES,
        F.col("all_events_pct").alias("events_pct"),
        F.col("all_pieces_pct").alias("pieces_pct"),
        (100 - F.col("all_fastest_pct")).alias("fastest_pct"),
        (100 - F.col("all_average_pct")).alias("average_pct"),
    )
    if name is not None:
        shown = for_competitor(shown, name)
    ranks = ranking.select(
        "name",
        "overall_rank",
        "rating_rank",
        "z_rank",
        "percentile_rank",
        F.bround("avg_rank", 2).alias("avg_rank"),
    )
    return lookup(shown, ranks, ["name"]).select(
        "*",
        ranking.agg(F.count(F.lit(1))).scalar().alias("eligible"),
        clock.format_timedelta(F.col("fastest")).alias("fastest_text"),
        clock.format_timedelta(F.col("average")).alias("average_text"),
    )


def event_entries(df: DataFrame) -> DataFrame:
    """Rows with a name per event: the T of "N of T"."""
    return df.groupBy("full_event").agg(F.count("name").alias("entries"))


def with_entrants(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Add the number of named rows of each row's event; NULL for an unknown event."""
    return lookup_figures(rows, event_entries(df), ["full_event"])


def competitor_series(
    df: DataFrame, name: str | None = None, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Times of the last year and a half with moving average, unique labels and dates.

    The moving average starts anew at the left end of the series.
    """
    timed = _named(df, name).dropna(subset=["seconds", "date", "full_event"])
    columns = ["name", "entry_id", "full_event", "date", "seconds", "rank", "pieces"]
    # The timeline reads its rows several times.
    timed = timed.select(*columns, measures.micros(F.col("seconds")).alias("__micros"))
    recent = settle(trailing_per_key(timed, "name", SERIES_DAYS))
    placed = timeline(recent, "__micros", one_task_rows=one_task_rows)
    rows = with_entrants(placed, _named(df))
    average = clock.hours(F.col("moving_average") / 1_000_000)
    return rows.select(
        "name",
        "entry_id",
        "full_event",
        "date",
        "rank",
        "pieces",
        "entries",
        clock.hours(F.col("seconds")).alias("hours"),
        clock.format_hms_hours(clock.hours(F.col("seconds"))).alias("hours_text"),
        average.alias("average_hours"),
        clock.format_hms_hours(average).alias("average_text"),
        "day_label",
        "label",
        "spread_date",
    )


def event_detail(
    df: DataFrame, name: str | None = None, full_event: str | None = None
) -> DataFrame:
    """One row per competitor and event: the event's figures beside the own first time.

    Nameless rows are left out. The curve and the leaderboard of the event are
    ``performance_curve`` and ``leaderboard`` of the named rows.
    """
    named = _named(df)
    if full_event is not None:
        named = named.filter(F.col("full_event") == full_event)
    own = named.filter(F.col("full_event").isNotNull()).groupBy("name", "full_event").agg(
        F.min_by("seconds", "entry_id").alias("own_seconds"),
        F.min("seconds").alias("__fastest"),
        F.sum(measures.micros(F.col("seconds"))).alias("__micros"),
        F.count("seconds").alias("__timed"),
    )
    events = own.groupBy("full_event").agg(
        F.count("name").alias("entrants"),
        F.min("__fastest").alias("fastest"),
        F.try_divide(measures.exact_total(F.col("__micros")), F.sum("__timed")).alias("average"),
    )
    if name is not None:
        own = for_competitor(own, name)
    rows = lookup_figures(own.select("name", "full_event", "own_seconds"), events, ["full_event"])
    return rows.select(
        "*",
        clock.format_timedelta(F.col("fastest")).alias("fastest_text"),
        clock.format_timedelta(F.col("average")).alias("average_text"),
        clock.format_timedelta(F.col("own_seconds")).alias("own_text"),
    )


_HISTORY = [
    "time_text", "ppm", "pieces", "remaining", "event_strength", "rating_out", "avg_12m_text",
]


def history(df: DataFrame, name: str | None = None) -> DataFrame:
    """Dated attempts with the rank as "N/T"; newest first when one competitor is asked."""
    rows = _dated(_named(df, name))
    listed = with_entrants(rows, _named(df)).select(
        "name",
        "entry_id",
        "date",
        "full_event",
        measures.rank_of_total(F.col("rank"), F.col("entries")).alias("rank_text"),
        *_HISTORY,
    )
    return listed if name is None else listed.orderBy(F.col("date").desc(), "entry_id")
