import pytest
from pyspark.sql import functions as F

import heatsheet as hs
from heatsheet import schema
from helpers import day


def _tables(spark):
    def frame(rows, columns):
        return spark.createDataFrame(rows, columns)

    return {
        "competition_entries": frame(
            [
                ("e1", "c1", 1, "t", "1:00:00", 3600.0, "500", None, 4),
                ("e2", "c1", 2, "t", "1:10:00", 4200.0, "500", "100", 5),
                ("e3", "c2", 1, "t", None, None, "500", "0", None),
                ("e4", "c9", 1, "t", "0:00:00", 0.0, "500", "500", 1),
            ],
            "entry_id string, competition_id string, competition_team_size int, load_timestamp string,"
            "time_value string, completion_time_seconds double, pieces_value string,"
            "remaining_value string, rank_in_competition bigint",
        ),
        "competitions": frame(
            [("c1", "Open One", "one", "2024-01-05", 1.5, "x"), ("c2", "Open Two", "two", "soon", 2.5, "x")],
            "competition_id string, competition_name string, source_tab_name string,"
            "competition_date string, event_strength_rating double, last_updated_timestamp string",
        ),
        "entry_competitors": frame(
            [("e1", "p1", "solo", "t"), ("e2", "p1", "team", "t"), ("e2", "p2", "team", "t"),
             ("e3", "p1", "solo", "t")],
            "entry_id string, competitor_id string, role_in_entry string, load_timestamp string",
        ),
        "competitors": frame(
            [("p1", "Ann"), ("p2", "Bob"), (None, "Nobody")],
            "competitor_id string, display_name string",
        ),
        "player_event_metrics": frame(
            [("p1", "c1", 1.1, 1.2, 3661.0, "1999-01-01", 77), ("p1", "c2", 1.3, 0.9, 60.0, None, 78)],
            "competitor_id string, competition_id string, rating_in double, rating_out double,"
            "rolling_12mo_avg_completion_time double, competition_date string,"
            "rank_in_competition bigint",
        ),
    }


def _by_key(fact):
    return {(r.entry_id, r.competitor_id): r for r in fact.collect()}


def test_build_results(spark):
    fact = hs.build_results(_tables(spark))
    assert fact.columns == schema.RESULTS.fieldNames()
    rows = _by_key(fact)
    assert set(rows) == {("e1", "p1"), ("e2", "p1"), ("e2", "p2"), ("e3", "p1"), ("e4", None)}
    one = rows["e1", "p1"]
    assert (one.name, one.event, one.full_event, one.date) == (
        "Ann", "one", "Open One", day("2024-01-05"),
    )
    assert (one.rank, one.remaining, one.avg_12m_text) == (4, 0.0, "01:01:01")  # left owner wins
    assert (one.ppm, one.time_penalty, one.corrected_time) == (500 / 60, 0.0, 3600.0)
    assert rows["e2", "p1"].corrected_time == 4200 + 100 * 4200 / 400
    # A row without a date counts as later than any date.
    assert (one.latest_rating, one.total_events) == (0.9, 3)
    assert (rows["e2", "p2"].latest_rating, rows["e2", "p2"].total_events) == (None, 1)
    lonely = rows["e4", None]
    assert (lonely.name, lonely.total_events, lonely.full_event) == (None, None, None)
    assert (lonely.ppm, lonely.time_penalty, lonely.corrected_time) == (None, None, None)


def test_unknown_keys_meet_only_when_asked(spark):
    assert _by_key(hs.build_results(_tables(spark), null_safe=True))["e4", None].name == "Nobody"


def test_repair_touches_the_named_events_only(spark):
    rows = _by_key(hs.build_results(_tables(spark), repair_events=["c1"]))
    assert [rows[k].rank for k in (("e1", "p1"), ("e2", "p1"), ("e2", "p2"))] == [1, 2, 2]
    assert rows["e4", None].rank == 1 and rows["e3", "p1"].rank is None


def test_missing_columns_are_named(spark):
    tables = _tables(spark)
    tables["competitors"] = tables["competitors"].drop("display_name")
    with pytest.raises(ValueError, match="display_name"):
        hs.build_results(tables)


def test_build_from_sheets(spark):
    sheets = spark.createDataFrame(
        [
            ("s1", 2, "Other title", " Ann ", "1:00:00", "100", "500"),
            ("s1", 1, "First title", "Bob", "DNF", "1:00:00", "x"),
            ("s2", 1, "Second", "Ann", "0:50:00", None, "1000"),
        ],
        "source string, row_no int, Event string, Name string, Time string, Remaining string,"
        "Pieces string",
    )
    ratings = spark.createDataFrame(
        [("First title", "Ann", 1.0, 2.0)],
        "`Event Name` string, `Player Name` string, rating_in double, `Score Out` double",
    )
    latest = spark.createDataFrame([("Ann", 9.0)], "Player string, latest_rating double")
    fact = hs.build_results_from_sheets(
        sheets, ratings, latest, headers={"Score Out": "rating_out"}
    )
    assert fact.columns == schema.RESULTS.fieldNames()
    rows = {(r.event, r.name): r for r in fact.collect()}
    ann = rows["s1", "Ann"]
    assert (ann.full_event, ann.seconds, ann.remaining, ann.pieces) == ("First title", 3600, 100, 500)
    assert (ann.corrected_time, ann.rating_out, ann.latest_rating) == (4500.0, 2.0, 9.0)
    bob = rows["s1", "Bob"]
    assert (bob.seconds, bob.remaining, bob.pieces, bob.latest_rating) == (None, 0.0, None, None)
    assert rows["s2", "Ann"].rating_out is None and rows["s2", "Ann"].corrected_time == 3000.0


def test_sheet_columns_have_a_place_or_are_refused(spark):
    columns = "source string, row_no int, entry_id int, event string, name string, time string, remaining string, pieces string"
    row = ("s1", 1, 1, "Title", "Ann", "1:00:00", None, "500")
    ratings = spark.createDataFrame([], "full_event string, name string, rating_out double")
    latest = spark.createDataFrame([("Ann", 9.0)], "Player string, latest_rating double")
    sheet = spark.createDataFrame([(*row, "8.3", "Aug 11, 2025", "x")], columns + ", PPM string, `Date` string, Notes string")
    with pytest.raises(ValueError, match="Notes"):
        hs.build_results_from_sheets(sheet, ratings, latest)
    found = hs.build_results_from_sheets(sheet, ratings, latest, junk=["Notes"]).first()
    assert (found.ppm, found.date.isoformat()) == (8.3, "2025-08-11")


def _join_plan(spark, monkeypatch, tables):
    """The plan of the joined rows, when no table is small enough to be sent to all tasks."""
    from heatsheet.plans import refresh

    plans, settle = [], refresh.settle
    monkeypatch.setattr(refresh, "settle", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sorted(map(str, hs.build_results(tables).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plans[0], rows


def test_tables_in_buckets_spare_the_exchanges_by_entry(spark, monkeypatch):
    plain, rows = _join_plan(spark, monkeypatch, _tables(spark))
    bucketed, same = _join_plan(spark, monkeypatch, hs.bucket_sources(_tables(spark), 8))
    assert same == rows
    assert plain.count("Exchange hashpartitioning(") == 8
    assert bucketed.count("Exchange hashpartitioning(") == 6 and "hashpartitioning(entry_id" not in bucketed


def test_competitions_are_joined_when_no_join_moves_the_rows_any_more(spark, monkeypatch):
    plan, _ = _join_plan(spark, monkeypatch, _tables(spark))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 4 and "competition_id" in joins[0] and "competitor_id" not in joins[0]


def test_competitions_that_bring_the_competitor_are_joined_before_it_is_needed(spark):
    tables = _tables(spark)
    owner = F.when(F.col("competition_id") == "c1", F.lit("p2"))
    tables["competitions"] = tables["competitions"].withColumn("competitor_id", owner)
    rows = {r.entry_id: r.name for r in hs.build_results(tables).collect()}
    assert rows == {"e1": "Bob", "e2": "Bob", "e3": None, "e4": None}


def test_totals_are_counted_before_the_ranks_are_repaired(spark, monkeypatch):
    from heatsheet.operators import joins

    plans, settle = [], joins.settle
    monkeypatch.setattr(joins, "settle", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df))[1])
    hs.build_results(_tables(spark), repair_events=["c1"]).collect()
    assert len(plans) == 1 and "Union" not in plans[0]
