"""Null, tie and denominator rules on small facts worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import heatsheet as hs
from heatsheet.plans import competitions
from helpers import day, facts, listed


def test_trailing_year_includes_the_cutoff(spark):
    dates = ["2023-03-30", "2023-03-31", "2024-03-31", None]
    rows = facts(spark, [{"date": d} for d in dates])
    assert listed(hs.trailing(rows, "2024-03-31"), "entry_id") == [(1,), (2,)]
    assert listed(hs.trailing(rows), "entry_id") == [(1,), (2,)]


def test_month_ends_are_clamped(spark):
    rows = facts(spark, [{"date": d} for d in ["2024-02-29", "2024-03-01", "2024-03-31"]])
    assert listed(hs.as_of_snapshot(rows, 1), "entry_id") == [(0,)]
    leap = facts(spark, [{"date": "2023-02-28"}, {"date": "2023-02-27"}])
    assert listed(hs.trailing(leap, "2024-02-29"), "entry_id") == [(0,)]


def test_trailing_per_key_uses_own_latest_date(spark):
    rows = facts(
        spark,
        [
            {"name": "A", "date": "2024-07-01"},
            {"name": "A", "date": "2023-01-01"},   # 547 days before
            {"name": "A", "date": "2022-12-31"},   # 548 days before
            {"name": "B", "date": "2020-01-01"},
        ],
    )
    assert listed(hs.trailing_per_key(rows, "name", 547), "entry_id") == [(0,), (1,), (3,)]


def test_having_count_drops_unknown_keys(spark):
    rows = facts(spark, [{"event": e} for e in ["x", "x", "y", None, None]])
    assert listed(hs.having_count(rows, "event", 2), "entry_id") == [(0,), (1,)]


def test_bad_names_are_reported_by_event(spark):
    rows = facts(
        spark,
        [
            {"name": "A", "full_event": "E1"},
            {"full_event": "E2"},
            {"full_event": "E1"},
            {"full_event": "E1"},
            {},
        ],
    )
    good, bad = hs.split_bad_names(rows)
    assert listed(good, "entry_id") == [(0,)]
    assert [r.full_event for r in bad.collect()] == ["E1", "E2"]


def test_comparison_needs_two_names(spark):
    rows = facts(spark, [{"name": n} for n in ["A", "B", "C", None]])
    with pytest.raises(ValueError, match="two names"):
        hs.for_competitors(rows, ["A", "A"])
    assert listed(hs.for_competitors(rows, ["A", "B"]), "name") == [("A",), ("B",)]
    table = spark.createDataFrame([("C",), (None,)], "name string")
    assert listed(hs.for_competitors(rows, table), "name") == [("C",)]


def _ranking_rows(spark):
    rows = []
    for event, times in {"e1": [100, 200, 300], "e2": [100, 110, 120, 130]}.items():
        for i, t in enumerate(times):
            rows.append({"name": f"P{i}", "event": event, "corrected_time": float(t)})
    return rows


def test_untimed_attempts_count_and_weigh(spark):
    rows = _ranking_rows(spark)
    rows.append({"name": "P3", "event": "e1"})  # untimed in the event with 3 known times
    fact = facts(spark, rows, date="2024-05-01", total_events=2)
    scored = hs.score_attempts(fact)
    mine = scored.filter("name = 'P3'").agg(F.sum("event_timed"), F.count("z")).first()
    assert tuple(mine) == (7, 1)
    ranking = hs.rankings(fact, "2024-05-01", 2, 1, weighted=True)
    found = {r.name: r for r in ranking.collect()}
    assert found["P3"].eligible_attempts == 2
    # z of P3 in e2 alone is the worst mean; weighted by 4 of 7 it is -1.16 * 4/7.
    z = -(130 - 115) / math.sqrt(500 / 3)
    weighted = {
        "P0": (3 * 1.0 + 4 * (15 / math.sqrt(500 / 3))) / 7,
        "P1": (0 + 4 * (5 / math.sqrt(500 / 3))) / 7,
        "P2": (-3.0 - 4 * (5 / math.sqrt(500 / 3))) / 7,
        "P3": 4 * z / 7,
    }
    order = sorted(weighted, key=weighted.get, reverse=True)
    assert [found[n].weighted_z_rank for n in order] == [1, 2, 3, 4]


def test_single_or_equal_times_have_deviation_one(spark):
    rows = [
        {"event": "one", "corrected_time": 90.0},
        {"event": "same", "corrected_time": 50.0},
        {"event": "same", "corrected_time": 50.0},
        {"event": "none"},
    ]
    stats = {r.event: r for r in hs.event_stats(facts(spark, rows)).collect()}
    assert [stats[e].sd_used for e in ("one", "same", "none")] == [1.0, 1.0, 1.0]
    assert [stats[e].iqr_used for e in ("one", "same", "none")] == [1.0, 1.0, 1.0]
    assert (stats["none"].timed, stats["none"].mean) == (0, None)
    scores = listed(hs.score_attempts(facts(spark, rows)), "z", "percentile")
    assert scores == [(0.0, 100.0), (0.0, 75.0), (0.0, 75.0), (None, None)]


def test_a_shared_name_has_one_row_per_pair(spark):
    rows = [
        {"name": "A", "latest_rating": 2.0, "total_events": 3, "corrected_time": 10.0},
        {"name": "A", "latest_rating": 1.0, "total_events": 5, "corrected_time": 20.0},
        {"name": "B", "latest_rating": 1.5, "total_events": 1, "corrected_time": 30.0},
        {"name": "C", "latest_rating": None, "total_events": 1, "corrected_time": 40.0},
    ]
    ranking = hs.rankings(facts(spark, rows, event="e", date="2024-01-01"), "2024-01-01", 1)
    found = listed(ranking, "name", "rating_rank", "z_rank", order="rating_rank")
    assert found == [("A", 1, 1), ("B", 2, 2), ("A", 3, 1), ("C", 4, 3)]


def test_rankings_default_to_today(spark):
    today = dt.date.today()
    rows = [
        {"name": "A", "date": today - dt.timedelta(days=30), "corrected_time": 1.0},
        {"name": "B", "date": today - dt.timedelta(days=900), "corrected_time": 1.0},
    ]
    ranking = hs.rankings(facts(spark, rows, event="e"), min_attempts=1)
    assert [r.name for r in ranking.collect()] == ["A"]


def test_events_below_the_minimum_and_unknown_events_drop_out(spark):
    rows = [{"event": e, "corrected_time": 1.0, "name": "A"} for e in ["x", "x", "y", None]]
    assert listed(hs.score_attempts(facts(spark, rows), min_event_attempts=2), "event") == [
        ("x",), ("x",),
    ]


def test_medals_need_a_date(spark):
    rows = [
        {"name": "A", "rank": 1, "date": "2024-01-01"},
        {"name": "A", "rank": 1},
        {"name": "A", "rank": 3, "date": "2024-01-02"},
        {"name": "B", "date": "2024-01-02"},
    ]
    medals = hs.medals(facts(spark, rows))
    assert listed(medals, "gold", "silver", "bronze", order="name") == [(1, 0, 1), (0, 0, 0)]
    table = hs.top_medalists(facts(spark, rows))
    assert listed(table, "name", "gold", "bronze", order="name") == [("A", 2, 1)]
    assert hs.medal_long(table).count() == 3


def test_empty_sums_are_zero_and_unranked(spark):
    rows = [
        {"name": "A", "full_event": "E", "date": "2024-01-01"},
        {"name": "B", "full_event": "E", "date": "2024-01-01", "pieces": 500.0, "seconds": 60},
    ]
    ranking = hs.rankings(facts(spark, []), "2024-01-01")
    profile = hs.competitor_profile(facts(spark, rows), ranking)
    found = {r.name: r for r in profile.collect()}
    assert (found["A"].pieces, found["A"].fastest, found["A"].fastest_pct) == (0.0, None, None)
    assert (found["A"].pieces_pct, found["B"].pieces_pct) == (50.0, 100.0)
    assert (found["B"].fastest_pct, found["B"].overall_rank, found["B"].eligible) == (0.0, None, 0)


def test_profile_figures_use_dated_rows_and_percentiles_all(spark):
    rows = [
        {"name": "A", "full_event": "E1", "date": "2024-01-01", "seconds": 100, "pieces": 500.0},
        {"name": "A", "full_event": "E2", "seconds": 10, "pieces": 500.0},
        {"name": "B", "full_event": "E1", "date": "2024-01-01", "seconds": 50, "pieces": 500.0},
    ]
    ranking = hs.rankings(facts(spark, []), "2024-01-01")
    a = hs.competitor_profile(facts(spark, rows), ranking, "A").first()
    assert (a.events, a.pieces, a.fastest, a.events_pct) == (1, 500.0, 100, 100.0)
    assert a.fastest_pct == 50.0 and a.fastest_text == "0:01:40"


def test_entrants_with_and_without_unknown(spark):
    rows = [{"full_event": "E", "name": n} for n in ["A", "A", "B", None, None]]
    one = hs.event_overview(facts(spark, rows)).first()
    assert (one.entrants, one.entrants_with_unknown) == (2, 3)
    assert hs.event_entries(facts(spark, rows)).first().entries == 3


def test_untimed_rows_stay_in_the_share_of_faster_rows(spark):
    rows = [
        {"full_event": "F", "seconds": 1},
        {"full_event": "F"},
        {"full_event": "E", "seconds": 3},
        {"full_event": "N"},
    ]
    found = {r.full_event: r for r in hs.event_overview(facts(spark, rows)).collect()}
    assert found["E"].fastest_pct == 25.0
    assert (found["F"].fastest_pct, found["N"].fastest_pct) == (0.0, 0.0)
    assert (found["N"].average_pct, found["N"].fastest_text) == (None, None)


def test_performance_runs_from_one_to_zero(spark):
    rows = [{"full_event": "one", "seconds": 5}]
    rows += [{"full_event": "three", "seconds": s} for s in (None, 10, 20)]
    curve = listed(hs.performance_curve(facts(spark, rows)), "full_event", "performance")
    assert curve == [("one", 1.0), ("three", 0.0), ("three", 1.0), ("three", 0.5)]
    assert hs.performance_curve(facts(spark, rows), "one").count() == 1


def test_leaderboard_puts_unranked_last(spark):
    rows = [{"full_event": "E", "rank": r, "name": n} for r, n in
            [(2, "A"), (None, "B"), (1, "D"), (1, "C")]]
    board = hs.leaderboard(facts(spark, rows), "E")
    assert [r.name for r in board.collect()] == ["C", "D", "A", "B"]


@pytest.mark.parametrize("limit", [1000, 2])
def test_moving_average_window(spark, limit):
    attempts = [
        ("2024-01-01", 1.0), ("2024-01-01", 2.0), ("2024-12-31", 3.0),
        ("2025-01-01", 4.0), ("2025-01-01", None), ("2025-01-02", 10.0),
    ]
    rows = facts(spark, [{"name": "A", "date": d, "ppm": v} for d, v in attempts])
    found = hs.moving_average(rows, "name", "date", "ppm", one_task_rows=limit)
    wanted = [1, 1.5, 3, 3.5, 3.5, 17 / 3]
    assert [v for (v,) in listed(found, "moving_average")] == pytest.approx(wanted)


def test_moving_average_of_unknown_values(spark):
    rows = facts(spark, [{"name": "A", "date": "2024-01-01"}])
    assert hs.moving_average(rows, "name", "date", "ppm").first().moving_average is None


@pytest.mark.parametrize("limit", [1000, 1])
def test_labels_and_spread_dates(spark, limit):
    days = ["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-05"]
    rows = facts(spark, [{"name": "A", "date": d} for d in days])
    labels = listed(hs.label_days(rows, one_task_rows=limit), "label")
    assert [v for (v,) in labels] == [
        "Jan 01, 2024", "Jan 01, 2024 (a)", "Jan 02, 2024", "Jan 05, 2024",
    ]
    spread = listed(hs.spread_dates(rows, one_task_rows=limit), "spread_date")
    assert [v.day for (v,) in spread] == [1, 2, 3, 5]


def test_repeats_beyond_the_alphabet_are_numbered(spark):
    rows = facts(spark, [{"name": "A", "date": "2024-01-01"}] * 29)
    labels = [v for (v,) in listed(hs.label_days(rows), "label")]
    assert labels[26:] == ["Jan 01, 2024 (z)", "Jan 01, 2024 (27)", "Jan 01, 2024 (28)"]


def test_spread_dates_equal_the_greedy_walk(spark):
    import random

    dice = random.Random(3)
    rows, wanted = [], []
    for case in range(40):
        used = set()
        offsets = sorted(dice.randrange(12) for _ in range(dice.randrange(1, 12)))
        for offset in offsets:
            day_ = dt.date(2024, 1, 1) + dt.timedelta(days=offset)
            rows.append({"name": f"N{case}", "date": day_})
            while day_ in used:
                day_ += dt.timedelta(days=1)
            used.add(day_)
            wanted.append(day_)
    spread = listed(hs.spread_dates(facts(spark, rows)), "spread_date")
    assert [v for (v,) in spread] == wanted


def test_series_starts_anew_at_its_left_end(spark):
    rows = [
        {"name": "A", "date": "2022-12-30", "seconds": 36000},
        {"name": "A", "date": "2023-01-01", "seconds": 3600},
        {"name": "A", "date": "2024-07-01", "seconds": 7200},
    ]
    series = listed(hs.competitor_series(facts(spark, rows, full_event="E"), "A"), "average_hours",
                    "hours_text", "entries")
    assert series == [(1.0, "01:00:00", 3), (2.0, "02:00:00", 3)]


def test_own_time_is_the_first_attempt(spark):
    rows = [
        {"name": "A", "full_event": "E", "seconds": 90},
        {"name": "A", "full_event": "E", "seconds": 30},
        {"name": "B", "full_event": "E", "seconds": 60},
        {"full_event": "E", "seconds": 1},
    ]
    detail = hs.event_detail(facts(spark, rows), "A", "E").first()
    assert (detail.own_seconds, detail.fastest, detail.entrants, detail.average) == (90, 30, 2, 60.0)
    assert detail.own_text == "0:01:30"


def test_history_rank_text(spark):
    rows = [
        {"name": "A", "full_event": "E", "rank": 2, "date": "2024-01-01"},
        {"name": "A", "full_event": "E", "date": "2024-02-01"},
        {"name": "A", "rank": 1, "date": "2024-03-01"},
        {"name": "A", "rank": 1},
    ]
    history = hs.history(facts(spark, rows), "A")
    assert [(r.entry_id, r.rank_text) for r in history.collect()] == [
        (2, "1/0"), (1, None), (0, "2/2"),
    ]
    compared = hs.compare_history(facts(spark, rows), None)
    assert [r.entry_id for r in compared.collect()] == [2, 1, 0, 3]


def test_compare_summary_sorts_by_shown_time(spark):
    rows = [
        {"name": "A", "seconds": 100, "ppm": 2.675, "date": "2024-06-01"},
        {"name": "B", "seconds": 50, "ppm": 1.0, "date": "2022-01-01"},
        {"name": "C", "seconds": 60, "ppm": None, "date": "2024-05-01"},
    ]
    fact = facts(spark, rows)
    ranking = hs.rankings(facts(spark, []), "2024-01-01")
    summary = hs.compare_summary(fact, ["A", "B", "C"], ranking)
    found = [(r.name, r.last_year_time, r.last_year_events, r.average_ppm) for r in summary.collect()]
    assert found == [
        ("B", "-", 0, "1.0"), ("C", "00:01:00", 1, "-"), ("A", "00:01:40", 1, "2.68"),
    ]
    assert [r.name for r in hs.compare_bars(summary).collect()] == ["C", "A"]


def test_ordered_attempts_number_from_zero(spark):
    rows = facts(spark, [{"name": n, "seconds": s} for n, s in [("A", 9), ("B", 5), ("A", None)]])
    found = listed(hs.ordered_attempts(rows, ["A", "B"]), "label")
    assert found == [("A 1",), ("B 0",), ("A 2",)]


def test_unknown_name_counts_once_in_growth_but_not_in_totals(spark):
    rows = [
        {"date": "2024-01-01", "full_event": "E"},
        {"date": "2024-01-02", "full_event": "E"},
        {"date": "2024-01-02", "full_event": "F", "name": "A"},
        {"date": "2024-01-03", "full_event": "F", "name": "A"},
        {"full_event": "G", "name": "B"},
    ]
    fact = facts(spark, rows)
    people = listed(hs.cumulative_competitors(fact), "date", "competitors", order="date")
    assert people == [(day("2024-01-01"), 1), (day("2024-01-02"), 2)]
    attempts = listed(hs.cumulative_entries(fact), "attempts", order="date")
    assert attempts == [(1,), (3,), (4,)]
    totals = hs.totals(fact).first()
    assert (totals.competitors, totals.events, totals.attempts, totals.seconds) == (2, 3, 5, 0)
    assert totals.seconds_text == "0:00:00"


def test_totals_delta_of_a_month(spark):
    rows = [
        {"date": "2024-02-29", "full_event": "E", "name": "A", "seconds": 10, "pieces": 500.0},
        {"date": "2024-03-31", "full_event": "E", "name": "B", "seconds": 5, "pieces": 500.0},
        {"full_event": "F", "name": "A"},
    ]
    one = hs.totals_delta(facts(spark, rows)).first()
    assert (one.events, one.events_before, one.events_delta) == (2, 1, 1)
    assert (one.competitors_before, one.competitors_delta) == (1, 1)
    assert (one.attempts_before, one.seconds_before, one.pieces_delta) == (1, 10, 500.0)
    empty = hs.totals_delta(facts(spark, [])).first()
    assert (empty.events, empty.attempts, empty.seconds_delta) == (0, 0, 0)


def test_latest_state_takes_columns_from_different_rows(spark):
    rows = [
        {"name": "A", "date": "2024-01-01", "full_event": "old", "avg_12m_text": "01:00:00"},
        {"name": "A", "date": "2024-02-01", "full_event": "new"},
        {"name": "A", "full_event": "undated", "total_events": 3},
        {"date": "2024-02-01", "full_event": "x"},
    ]
    state = hs.latest_state(facts(spark, rows)).collect()
    assert len(state) == 1
    one = state[0]
    assert (one.full_event, one.avg_12m_text, one.total_events) == ("new", "01:00:00", 3)
    assert one.date == day("2024-02-01")


def test_time_search_range(spark):
    texts = {"A": "01:00:00", "B": "03:00:00", "C": "03:00:01", "D": None, "E": "10:00"}
    rows = facts(spark, [{"name": n, "avg_12m_text": t} for n, t in texts.items()])
    assert [r.name for r in hs.time_search(rows).collect()] == ["D", "E", "A", "B", "C"]
    assert [r.name for r in hs.time_search(rows, hi=10800).collect()] == ["D", "E", "A", "B"]
    assert [r.name for r in hs.time_search(rows, 3600, 10800).collect()] == ["A", "B"]
    counts = hs.time_search_counts(rows, 3600, 10800).first()
    assert tuple(counts) == (2, 5, 0)


def test_rank_pairs_skip_missing_ranks(spark):
    ranking = spark.createDataFrame(
        [("A", 3, 1, 1, 2, 1.5, 1), ("B", 4, 2, 2, None, 2.0, 2)],
        "name string, eligible_attempts bigint, rating_rank int, z_rank int, "
        "percentile_rank int, avg_rank double, overall_rank int",
    )
    assert hs.rank_pairs(ranking).count() == 6 + 3
    bounds = {(r.x_col, r.y_col): (r.low, r.high) for r in hs.rank_pair_bounds(ranking).collect()}
    assert bounds["rating_rank", "z_rank"] == (1.0, 2.0)
    assert bounds["rating_rank", "percentile_rank"] == (2.0, 1.0)
    assert bounds["percentile_rank", "avg_rank"] == (2.0, 1.5)
    assert hs.min_eligible(ranking).first().min_eligible == 3


def _density(rows, spark):
    return hs.density(facts(spark, rows))


def test_density_needs_two_different_times(spark):
    base = [{"full_event": "B", "seconds": s} for s in (3600, 7200, 9000)]
    single = [{"full_event": "one", "seconds": 3600}]
    equal = [{"full_event": "same", "seconds": 3600}] * 3
    late = [{"full_event": "late", "seconds": s} for s in (18001, 20000)]
    found = _density(base + single + equal + late, spark).select("full_event").distinct()
    assert [r.full_event for r in found.collect()] == ["B"]
    assert _density(equal, spark).count() == 0
    assert _density([], spark).count() == 0


def test_density_formula(spark):
    times = [3600, 3600, 7200, 10800]
    rows = [{"full_event": "E", "seconds": s} for s in times]
    found = listed(_density(rows, spark), "x", "y_event", "y_all", order="point")
    hours = [t / 3600 for t in times]
    mean = sum(hours) / 4
    sd = math.sqrt(sum((h - mean) ** 2 for h in hours) / 3)
    width = sd * 4 ** -0.2
    for x, y, y_all in (found[0], found[100], found[499]):
        total = sum(math.exp(-(((x - h) / width) ** 2) / 2) for h in hours)
        assert y == pytest.approx(total / (4 * width * math.sqrt(2 * math.pi)))
        assert y == pytest.approx(y_all)
    assert found[499][0] == 5.0 and len(found) == 500


def test_five_numbers(spark):
    rows = facts(spark, [{"name": "A", "date": f"2024-01-0{i}", "full_event": "E"} for i in
                         (1, 2, 3, 4, 5)])
    box = hs.five_number(hs.with_attempt_number(rows), "full_event", "attempt_number").first()
    assert (box.low, box.q1, box.median, box.q3, box.high) == (1, 2, 3, 4, 5)


def test_five_numbers_make_their_rows_once(spark, monkeypatch):
    settled, plain = [], competitions.settle
    monkeypatch.setattr(competitions, "settle", lambda df: settled.append(df.columns) or plain(df))
    rows = facts(spark, [{"name": "A", "date": f"2024-01-0{i}", "full_event": "E"} for i in (1, 2, 3)])
    numbered = hs.with_attempt_number(rows, 2)
    box = hs.five_number(numbered, "full_event", "attempt_number", 2).first()
    # all that follows reads the stored values, and no attempt is numbered again
    assert (box.low, box.median, box.high) == (1, 2, 3) and settled == [["full_event", "attempt_number"]]
