"""Every query of the library on the given tables, over all competitors or events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import heatsheet as hs
from heatsheet.functions import clock, measures
from heatsheet.scratch import shared_path
from heatsheet.settings import ONE_TASK_ROWS, SEARCH_MAX_SECONDS
from heatsheet.sources.tables import size_class

from . import binding

Query = Callable[[SparkSession, str], DataFrame]


_EXACT = {"rating_out", "latest_rating"}  # passed through, never summed


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at fixed places: sums in another order differ in the last digits."""
    inexact = {c for c, kind in df.dtypes if kind == "double"} - _EXACT
    return df.select(
        *[_rounded(F.col(c), places).alias(c) if c in inexact else F.col(c) for c in df.columns]
    )


def _rounded(value: Column, places: int) -> Column:
    """The same as ``round``, which makes decimals and text of each value, without them for most.

    Away from ties the nearest whole number of units is sure, and dividing it gives the double
    nearest to the decimal. Ties, and values with few digits to spare, are left to ``round``.
    """
    unit = F.lit(10.0**places)
    units = value * unit
    nearest = F.rint(units)
    sure = (F.abs(units) < 1e12) & (F.abs(units - nearest) < 0.499)
    return F.when(sure, nearest / unit + 0.0).otherwise(F.round(value, places))  # adding 0 turns -0.0 into 0.0


def _on_results(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(query(binding.results(spark, sf_dir)))


def _on_ranking(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(query(binding.ranking(spark, sf_dir)))


def _on_both(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(
        query(binding.results(spark, sf_dir), binding.ranking(spark, sf_dir))
    )


def _on_fact(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(query(binding.fact(spark, sf_dir)))


def _build_results(spark, sf_dir):
    tables = binding.star_tables(spark, sf_dir)
    return rounded(hs.build_results(tables, repair_events=["1997-03", "1998-05"]))


def _build_from_sheets(spark, sf_dir):
    cells, event_ratings, latest = binding.sheets(spark, sf_dir)
    built = hs.build_results_from_sheets(cells, event_ratings, latest, junk=["unnamed_11"])
    return rounded(
        built.select(
            "entry_id", "name", "event", "full_event", "time_text", "seconds", "pieces",
            "remaining", "time_penalty", "corrected_time", "rating_out", "latest_rating",
            "total_events", "date", "rank", "ppm", "rating_in", "event_strength", "avg_12m_text",
        )
    )


def _clock_texts(spark, sf_dir):
    """Scalar functions over texts derived from line items."""
    lines = binding.table(spark, sf_dir, "lineitem")
    spent = F.floor(F.col("l_extendedprice") * 3)
    text = (
        F.when(F.col("l_linenumber") == 1, clock.format_hms(spent))
        .when(F.col("l_linenumber") == 2, F.concat(F.col("l_partkey").cast("string"), F.lit(":07")))
        .when(F.col("l_linenumber") == 3, F.lit("no time"))
        .when(F.col("l_linenumber") == 4, None)
        .otherwise(F.lit("1:2:x"))
    )
    lines = lines.withColumns({"time_text": text, "spent": spent})
    text, spent, ratio = F.col("time_text"), F.col("spent"), F.col("l_discount") / 8
    lines = lines.withColumn("strict_seconds", clock.parse_hms_strict(text))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "time_text",
        "strict_seconds",
        clock.parse_hms_lenient(text).alias("lenient_seconds"),
        clock.format_hms_or_dash(F.col("strict_seconds")).alias("dashed"),
        clock.format_timedelta(spent).alias("span"),
        clock.format_hms_hours(clock.hours(F.col("l_partkey"))).alias("hours_text"),
        clock.day_label(F.col("l_shipdate").cast("date")).alias("day_label"),
        clock.to_day(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"),
        measures.clean_remaining(text).alias("remaining"),
        measures.clean_name(F.concat(F.lit(" \t"), "l_returnflag", F.lit(" "))).alias("flag"),
        measures.round_or_dash(F.when(F.col("l_linenumber") != 4, ratio)).alias("shown_ratio"),
        measures.rank_of_total(
            F.when(F.col("l_linenumber") != 5, F.col("l_linenumber")), F.col("l_suppkey")
        ).alias("place"),
    )


def _moving_average(rows):
    named = rows.filter(F.col("name").isNotNull() & F.col("date").isNotNull())
    return hs.moving_average(named, "name", "date", "ppm").select(
        "entry_id", "name", "date", "moving_average"
    )


def _label_days(rows):
    named = rows.filter(F.col("name").isNotNull() & F.col("date").isNotNull())
    return hs.label_days(named).select("entry_id", "name", "date", "label")


def _spread_dates(rows):
    named = rows.filter(F.col("name").isNotNull() & F.col("date").isNotNull())
    return hs.spread_dates(named).select("entry_id", "name", "date", "spread_date")


def _population(rows, one_task_rows=ONE_TASK_ROWS):
    people = rows.filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.count_distinct("full_event").alias("events"), F.min("seconds").alias("fastest")
    )
    return hs.population_pct(people, ["events", "fastest"], one_task_rows)


def _scores(rows):
    return hs.score_attempts(rows, min_event_attempts=10).select(
        "entry_id", "event", "event_timed", "z", "percentile"
    )


def _snapshot(rows):
    early = hs.as_of_snapshot(rows, 12).select("entry_id", "date")
    return hs.trailing(early)


def _attempt_boxes(rows, one_task_rows=ONE_TASK_ROWS):
    careers = rows.select("full_event", "name", "date", "entry_id")
    numbered = hs.with_attempt_number(careers, one_task_rows)
    return hs.five_number(numbered, "full_event", "attempt_number", one_task_rows)


def _regulars(rows):
    frequent = hs.having_count(rows.select("entry_id", "name", "date"), "name", 8)
    return hs.trailing_per_key(frequent.filter(F.col("date").isNotNull()), "name", 547)


def _positions(rows):
    order = [F.col("corrected_time").asc_nulls_last(), F.col("entry_id")]
    keyed = rows.select("entry_id", "corrected_time")
    return hs.with_position(keyed, "position", order)


def _bucketed(spark, sf_dir):
    tables = hs.bucket_sources(binding.star_tables(spark, sf_dir), 8)
    return rounded(hs.build_results(tables, repair_events=["1997-03", "1998-05"]))


def _listed_tables(spark, sf_dir):
    """Rows of every table of the folder, and of one that is not there."""
    tables = hs.load_tables(spark, sf_dir, layout="{name}.parquet")
    tables |= hs.load_tables(spark, sf_dir, [], ["competitors"], layout="{name}.parquet")
    counts = [
        t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _written(spark, sf_dir, write, load, old, new):
    """What a reader finds after a table was written twice."""
    path = shared_path(spark, "table-")
    write(old, path)
    write(new, path)
    return load(spark, path)


def _loaded_results(spark, sf_dir):
    fact = binding.fact(spark, sf_dir)
    write = lambda df, path: hs.write_results(df, path, ["date", "entry_id"])
    loaded = _written(spark, sf_dir, write, hs.load_results, fact.filter("entry_id % 2 = 0"), fact)
    return loaded.select("entry_id", "name", "date", "seconds", "pieces")


def _csv_results(spark, sf_dir):
    fact = binding.fact(spark, sf_dir)
    loaded = _written(spark, sf_dir, hs.write_results_csv, hs.load_results_csv, fact.limit(0), fact)
    return loaded.select("entry_id", "name", "full_event", "date", "seconds", "rank", "rating_out", "total_events")


def _loaded_rankings(spark, sf_dir):
    ranking = binding.ranking(spark, sf_dir)
    return rounded(_written(spark, sf_dir, hs.write_rankings, hs.load_rankings, ranking.filter("z_rank = 1"), ranking))


def _sheet_union(spark, sf_dir):
    paths = binding.sheet_files(spark, sf_dir)
    tagged = hs.tag_source(hs.union_sources(spark, paths, named_by="folder"))
    return tagged.select("event", "full_event", "entry_id", "name", "time", "pieces")


def _some_competitors(rows):
    names = rows.filter(F.col("name").endswith("7")).select("name").distinct()
    return hs.for_competitors(rows, names).select("entry_id", "name")


# A limit that makes nearly every group take the way of groups too large for one task.
_FEW = 10


def queries() -> dict[str, Query]:
    return _plain_queries() | {
        "build_results_bucketed": _bucketed,
        "listed_tables": _listed_tables,
        "loaded_results": _loaded_results,
        "loaded_results_csv": _csv_results,
        "loaded_rankings": _loaded_rankings,
        "sheet_union": _sheet_union,
        "unread_dates": lambda spark, sf_dir: clock.unread_days(binding.sheets(spark, sf_dir)[0], "Date"),
        "one_competitor": _on_results(
            lambda rows: hs.for_competitor(rows, "Customer#000000010").select("entry_id", "name", "date", "seconds")
        ),
        "some_competitors": _on_results(_some_competitors),
        # the same by the way of large groups
        "event_stats_split": _on_results(lambda rows: hs.event_stats(rows, one_task_rows=_FEW)),
        "attempt_boxes_split": _on_results(lambda rows: _attempt_boxes(rows, _FEW)),
        "score_attempts_split": _on_results(
            lambda rows: hs.score_attempts(rows, min_event_attempts=10, one_task_rows=_FEW).select(
                "entry_id", "event", "event_timed", "z", "percentile"
            )
        ),
        "population_pct_split": _on_results(lambda rows: _population(rows, _FEW)),
        "performance_curve_split": _on_results(lambda rows: hs.performance_curve(rows, one_task_rows=_FEW)),
        "leaderboard_split": _on_results(lambda rows: hs.leaderboard(rows, one_task_rows=_FEW)),
    }


def _plain_queries() -> dict[str, Query]:
    return {
        # building
        "result_fact": lambda spark, sf_dir: rounded(binding.build_fact(spark, sf_dir)),
        "build_results": _build_results,
        "build_results_from_sheets": _build_from_sheets,
        "size_class": _on_fact(lambda fact: size_class(fact).select("entry_id", "pieces")),
        "repair_ranks": _on_fact(
            lambda fact: hs.repair_ranks(fact, [binding.UNRANKED_EVENT, "1996-06|5-LOW"]).select(
                "entry_id", "event", "rank"
            )
        ),
        "clock_texts": _clock_texts,
        # ranking
        "rankings": _on_results(binding.build_ranking),
        "rankings_weighted": _on_results(
            lambda rows: binding.build_ranking(rows, weighted=True)
        ),
        "event_stats": _on_results(hs.event_stats),
        "score_attempts": _on_results(_scores),
        "min_eligible": _on_ranking(hs.min_eligible),
        "rank_pairs": _on_ranking(hs.rank_pairs),
        "rank_pair_bounds": _on_ranking(hs.rank_pair_bounds),
        # competitors
        "medals": _on_results(hs.medals),
        "competitor_stats": _on_results(hs.competitor_stats),
        "population_pct": _on_results(_population),
        "competitor_profile": _on_both(hs.competitor_profile),
        "competitor_series": _on_results(hs.competitor_series),
        "moving_average": _on_results(_moving_average),
        "label_days": _on_results(_label_days),
        "spread_dates": _on_results(_spread_dates),
        "event_detail": _on_results(hs.event_detail),
        "event_entries": _on_results(hs.event_entries),
        "history": _on_results(hs.history),
        "bad_name_events": _on_results(lambda rows: hs.split_bad_names(rows)[1]),
        "distinct_names": _on_results(lambda rows: hs.distinct_keys(rows, "name")),
        "snapshot_year": _on_results(_snapshot),
        "regulars": _on_results(_regulars),
        "positions": _on_results(_positions),
        # events
        "event_overview": _on_results(hs.event_overview),
        "performance_curve": _on_results(hs.performance_curve),
        "leaderboard": _on_results(hs.leaderboard),
        "density": _on_results(hs.density),
        "attempt_boxes": _on_results(_attempt_boxes),
        # comparison
        "compare_summary": _on_both(lambda rows, ranks: hs.compare_summary(rows, None, ranks)),
        "compare_bars": _on_both(
            lambda rows, ranks: hs.compare_bars(hs.compare_summary(rows, None, ranks))
        ),
        "rating_series": _on_results(lambda rows: hs.rating_series(rows, None)),
        "ordered_attempts": _on_results(lambda rows: hs.ordered_attempts(rows, None)),
        "compare_history": _on_results(lambda rows: hs.compare_history(rows, None)),
        # dashboard and medal table
        "totals": _on_results(hs.totals),
        "totals_delta": _on_results(hs.totals_delta),
        "cumulative_competitors": _on_results(hs.cumulative_competitors),
        "cumulative_events": _on_results(hs.cumulative_events),
        "cumulative_entries": _on_results(hs.cumulative_entries),
        "most_frequent": _on_results(hs.most_frequent),
        "top_medalists": _on_results(hs.top_medalists),
        "medal_long": _on_results(lambda rows: hs.medal_long(hs.top_medalists(rows))),
        # time search
        "latest_state": _on_results(hs.latest_state),
        "time_search": _on_results(lambda rows: hs.time_search(rows, hi=SEARCH_MAX_SECONDS)),
        "time_search_all": _on_results(hs.time_search),
        "time_search_counts": _on_results(lambda rows: hs.time_search_counts(rows, 5400, 9000)),
    }
