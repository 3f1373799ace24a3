"""Binds the library to the given tables.

There are no competition results in them, so orders stand in: a competition is an (order
month, priority), a competitor is a customer, and the time comes from the price. Missing
names, dates, times and sizes, unfinished attempts, shared names and an event without
ranks are put in on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import heatsheet as hs
from heatsheet import schema
from heatsheet.functions import clock, measures
from heatsheet.operators.joins import lookup
from heatsheet.operators.ordering import by_size, group_sizes
from heatsheet.plans.refresh import with_competitor_totals, with_measures
from heatsheet.scratch import shared_path
from heatsheet.settings import ONE_TASK_ROWS
from heatsheet.sources.files import list_folder
from heatsheet.sources.tables import size_class

UNRANKED_EVENT = "1997-03|1-URGENT"

_settled: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return hs.load_tables(spark, sf_dir, [name], layout="{name}.parquet")[name]


def _once(spark: SparkSession, sf_dir: str, what: str, build) -> DataFrame:
    """Build and settle a table once per application, as the refresh job would."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _settled:
        _settled[key] = hs.settle(build())
    return _settled[key]


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result fact, every size class."""
    return _once(spark, sf_dir, "fact", lambda: build_fact(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages read: one size class and the unknown sizes."""
    return size_class(fact(spark, sf_dir))


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published ranking."""
    return _once(spark, sf_dir, "ranking", lambda: build_ranking(results(spark, sf_dir)))


def build_ranking(rows: DataFrame, min_attempts=3, min_event_attempts=10, weighted=False):
    return hs.rankings(rows, hs.latest_date(rows), min_attempts, min_event_attempts, weighted)


def _half_seconds() -> Column:
    """A time with a fraction, from the price of an order."""
    return F.floor(F.col("o_totalprice") / 25 * 2) / F.lit(2.0)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    key, month = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM")
    neighbour = F.lpad((F.col("o_custkey") - 1).cast("string"), 9, "0")
    return rows.select(
        key.alias("entry_id"),
        F.col("o_custkey").alias("competitor_id"),
        F.when(key % 97 == 0, None)
        .when(F.col("o_custkey") % 50 == 1, F.concat(F.lit("Customer#"), neighbour))
        .otherwise(F.col("c_name"))
        .alias("name"),
        F.concat(month, F.lit("|"), "o_orderpriority").alias("event"),
        F.concat(F.lit("Open "), month, F.lit(" "), "o_orderpriority").alias("full_event"),
        F.when(key % 211 != 0, F.trunc(F.col("o_orderdate").cast("date"), "month")).alias("date"),
        F.when(key % 23 == 0, None)
        .when(key % 10 == 9, F.lit(1000.0))
        .otherwise(F.lit(500.0))
        .alias("pieces"),
        F.when(key % 53 != 0, _half_seconds()).alias("seconds"),
        F.when(F.col("o_orderstatus") == "P", (key % 120).cast("double"))
        .otherwise(F.lit(0.0))
        .alias("remaining"),
        F.when(key % 41 != 0, F.col("o_totalprice") / 100000).alias("rating_out"),
    )


def _year():
    return Window.partitionBy("competitor_id").orderBy(F.unix_date("date")).rangeBetween(-364, 0)


def _year_average(rows: DataFrame) -> DataFrame:
    """Add the mean time of the year up to each row's day, as text.

    Times are whole halves of a second, so their sum is exact in any order. The rows move once,
    by competitor, and not again by day.
    """
    year = _year()
    average = F.try_divide(F.sum("seconds").over(year), F.count("seconds").over(year))
    dated = F.col("date").isNotNull() & F.col("competitor_id").isNotNull()
    return rows.withColumn("avg_12m_text", F.when(dated, clock.format_hms(average)))


def _year_average_by_day(rows: DataFrame) -> DataFrame:
    """The same for competitors with more rows than one task may order: windows run over their days."""
    daily = rows.filter(F.col("date").isNotNull()).groupBy("competitor_id", "date").agg(
        measures.exact_sum(F.col("seconds")).alias("sum"), F.count("seconds").alias("known")
    )
    year = _year()
    average = F.try_divide(F.sum("sum").over(year), F.sum("known").over(year))
    paces = daily.select("competitor_id", "date", clock.format_hms(average).alias("avg_12m_text"))
    return lookup(rows, paces, ["competitor_id", "date"])


def build_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hs.settle(with_measures(attempts(spark, sf_dir)))
    ranked = hs.with_rank(rows, "rank", "corrected_time", ["event"], "dense")
    rank = F.when(F.col("event") != UNRANKED_EVENT, F.col("rank"))
    ranked = with_competitor_totals(ranked.withColumn("rank", rank))
    sizes = group_sizes(rows, ["competitor_id"])
    rows = by_size(ranked, ["competitor_id"], ONE_TASK_ROWS, sizes, _year_average, lambda many, _: _year_average_by_day(many))
    rows = rows.withColumn("time_text", clock.format_hms(F.col("seconds")))
    return schema.conform(rows, schema.RESULTS, keep_types=("entry_id", "competitor_id"))


def _unmatched(key: str, every: int) -> Column:
    """The key, negative where it divides by ``every``, so that nothing matches it."""
    return F.when(F.col(key) % every == 0, -F.col(key)).otherwise(F.col(key))


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Five source tables from line items, orders and customers.

    An entry is an order; its team is one member per line number; some entries have no
    team, some competitors no name and some no metrics. Every row is in: keys that shall not
    match are changed.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    month = F.date_format("o_orderdate", "yyyy-MM")
    member = (F.col("l_suppkey") * 7 + F.col("l_linenumber")).alias("competitor_id")
    entries = orders.select(
        F.col("o_orderkey").alias("entry_id"),
        month.alias("competition_id"),
        F.lit(2).alias("competition_team_size"),
        F.lit("x").alias("load_timestamp"),
        clock.format_hms(F.floor(F.col("o_totalprice") / 25)).alias("time_value"),
        F.when(F.col("o_orderkey") % 53 != 0, _half_seconds()).alias("completion_time_seconds"),
        F.lit("500").alias("pieces_value"),
        F.when(F.col("o_orderstatus") == "P", (F.col("o_orderkey") % 120).cast("string")).alias(
            "remaining_value"
        ),
        (F.col("o_orderkey") % 50).alias("rank_in_competition"),
    )
    # one group a month; a largest text in the aggregate would have all orders sorted
    monthly = orders.groupBy(month.alias("month")).agg(F.avg("o_totalprice").alias("price"))
    month_text = F.col("month")
    competitions = monthly.select(
        F.when(month_text.endswith("-02"), F.concat(F.lit("-"), month_text)).otherwise(month_text).alias("competition_id"),
        F.concat(F.lit("Open "), month_text).alias("competition_name"),
        month_text.alias("source_tab_name"),
        F.concat(month_text, F.lit("-15")).alias("competition_date"),
        F.round(F.col("price") / 100000, 4).alias("event_strength_rating"),
        F.lit("x").alias("last_updated_timestamp"),
    )
    bridge = lines.select(
        _unmatched("l_orderkey", 19).alias("entry_id"), member, F.lit("solver").alias("role_in_entry"),
        F.lit("x").alias("load_timestamp"),
    ).repartition("entry_id").distinct()  # moved once, for this and the join by entry
    competitors = customers.select(
        _unmatched("c_custkey", 13).alias("competitor_id"), F.col("c_name").alias("display_name")
    )
    metrics = (
        lines.join(orders.hint("shuffle_hash"), lines.l_orderkey == orders.o_orderkey)
        .select(member, month.alias("competition_id"), "l_quantity", "l_extendedprice")
        .groupBy("competitor_id", "competition_id")
        .agg(
            F.max("l_quantity").alias("rating_in"),
            F.min("l_quantity").alias("rating_out"),
            F.max("l_extendedprice").alias("rolling_12mo_avg_completion_time"),
            F.lit(None).cast("date").alias("competition_date"),
            F.lit(-1).alias("rank_in_competition"),
        )
        .withColumn("competitor_id", _unmatched("competitor_id", 11))
    )
    return {
        "competition_entries": entries,
        "competitions": competitions,
        "entry_competitors": bridge,
        "competitors": competitors,
        "player_event_metrics": metrics,
    }


# Shapes of dates in the sheets, by the remainder of the entry id.
DAY_SHAPES = [
    "M/d/yyyy", "MMM d, yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "yyyy/MM/dd", "MM-dd-yyyy",
    "d MMM yyyy", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss",
]


def _day_text(key: Column) -> Column:
    """The date in one of several shapes; some cannot be read."""
    n = len(DAY_SHAPES)
    shaped = [F.when(key % n == i, F.date_format("date", shape)) for i, shape in enumerate(DAY_SHAPES)]
    return F.when(key % 47 == 0, F.concat(F.lit("soon "), (key % 3).cast("string"))).otherwise(F.coalesce(*shaped))


def sheet_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """A folder with one CSV file for each month; every second month has other columns."""
    rows = attempts(spark, sf_dir).filter(F.col("event").isNotNull())
    title = F.concat(F.lit("Title "), "entry_id", F.lit(", \"of\" "), "full_event")
    cells = rows.select(
        F.substring("event", 1, 7).alias("sheet"),
        "entry_id", title.alias("event"), "name", clock.format_hms(F.col("seconds")).alias("time"),
        F.col("pieces").cast("bigint").cast("string").alias("pieces"),
    )
    odd = F.substring("sheet", 7, 1).cast("int") % 2 == 1
    paths = []
    for part in (cells.filter(odd), cells.filter(~odd).drop("pieces")):
        base = shared_path(spark, "sheets-")
        dealt = part.repartition("sheet").sortWithinPartitions("sheet", "entry_id")
        dealt.write.partitionBy("sheet").option("header", True).csv(base)
        paths += [f"{base}/{name}" for name in list_folder(spark, base)]
    return paths


def sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Event sheets with untidy cells, event ratings and latest ratings."""
    rows = attempts(spark, sf_dir)
    key = F.col("entry_id")
    clock_text = clock.format_hms(F.col("seconds"))
    title = F.concat(F.lit("Title "), "entry_id", F.lit(" of "), "full_event")
    cells = rows.select(
        F.col("event").alias("source"),
        key.alias("row_no"),
        "entry_id",
        title.alias("event"),
        F.concat(F.lit("  "), "name", F.lit("\t ")).alias("name"),
        F.when(key % 31 == 0, F.substring(clock_text, 4, 5))
        .when(key % 37 == 0, F.lit("DNF"))
        .otherwise(clock_text)
        .alias("time"),
        F.when(key % 29 == 0, clock_text)
        .when(key % 31 == 0, None)
        .otherwise(F.col("remaining").cast("bigint").cast("string"))
        .alias("remaining"),
        F.when(key % 43 == 0, F.lit("five hundred"))
        .otherwise(F.col("pieces").cast("bigint").cast("string"))
        .alias("pieces"),
        _day_text(key).alias("Date"),
        (key % 50).cast("string").alias("Rank"),
        (key % 7 + 0.5).cast("string").alias("PPM"),
        (key % 10).cast("string").alias("Rating In"),
        (key % 9).cast("string").alias("Event Strength"),
        clock_text.alias("12-Month Avg Completion Time"),
        F.lit("junk").alias("unnamed_11"),
    )
    event_ratings = rows.filter(F.col("name").isNotNull()).groupBy("event", "name").agg(
        F.max("rating_out").alias("rating_out")
    )
    firsts = rows.groupBy("event").agg(F.min("entry_id").alias("first"))
    full = F.concat(F.lit("Title "), "first", F.lit(" of "), F.regexp_replace("__full", r"\|", " "))
    event_ratings = (
        lookup(event_ratings, firsts, ["event"])
        .withColumn("__full", F.concat(F.lit("Open "), "event"))
        .select(full.alias("full_event"), "name", "rating_out")
    )
    latest = rows.filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.min("rating_out").alias("latest_rating"), F.count(F.lit(1)).alias("total_events")
    )
    return cells, event_ratings, latest
