"""Properties that hold on any data, and results that do not depend on partitioning."""

import pytest
from pyspark.sql import functions as F

import heatsheet as hs
from checks import binding
from checks.registry import rounded


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return binding.results(spark, sf_dir)


def test_mean_z_is_zero_and_percentiles_are_in_range(rows):
    scored = hs.score_attempts(rows)
    worst = scored.groupBy("event").agg(F.avg("z").alias("m")).agg(F.max(F.abs("m"))).first()[0]
    assert worst < 1e-9
    low, high, unknown = scored.agg(
        F.min("percentile"), F.max("percentile"),
        F.count_if(F.col("percentile").isNull() != F.col("corrected_time").isNull()),
    ).first()
    assert 0 < low and high <= 100 and unknown == 0


def test_growth_ends_at_the_totals(rows):
    dated = rows.filter("date IS NOT NULL AND name IS NOT NULL")
    totals = hs.totals(dated).first()
    for growth, column in (
        (hs.cumulative_competitors, "competitors"),
        (hs.cumulative_events, "events"),
        (hs.cumulative_entries, "attempts"),
    ):
        series = [r[column] for r in growth(dated).orderBy("date").collect()]
        assert series == sorted(series) and series[-1] == totals[column]


def test_spread_dates_are_unique_and_never_earlier(rows):
    dated = rows.filter("date IS NOT NULL AND name IS NOT NULL")
    spread = hs.spread_dates(dated)
    assert spread.filter("spread_date < date").count() == 0
    assert spread.select("name", "spread_date").distinct().count() == dated.count()


def test_labels_are_unique_inside_a_competitor(rows):
    dated = rows.filter("date IS NOT NULL AND name IS NOT NULL")
    labelled = hs.label_days(dated)
    assert labelled.select("name", "label").distinct().count() == dated.count()


def test_leaderboard_positions_are_gapless(rows):
    gaps = hs.leaderboard(rows).groupBy("full_event").agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("last"),
        F.count_distinct("position").alias("different"),
    )
    assert gaps.filter("n <> last OR n <> different").count() == 0


def test_one_key_equals_its_part_of_all_keys(spark, rows, sf_dir):
    ranking = binding.ranking(spark, sf_dir)
    name = hs.most_frequent(rows, 1).first().name
    event = rows.filter(F.col("name") == name).orderBy("entry_id").first().full_event
    by_name = {
        "profile": lambda *key: hs.competitor_profile(rows, ranking, *key),
        "series": lambda *key: hs.competitor_series(rows, *key),
        "history": lambda *key: hs.history(rows, *key),
        "medals": lambda *key: hs.medals(rows, *key),
        "stats": lambda *key: hs.competitor_stats(rows, *key),
        "detail": lambda *key: hs.event_detail(rows, *key),
    }
    by_event = {
        "overview": lambda *key: hs.event_overview(rows, *key),
        "curve": lambda *key: hs.performance_curve(rows, *key),
        "board": lambda *key: hs.leaderboard(rows, *key),
        "density": lambda *key: hs.density(rows, *key),
    }
    for column, key, queries in (("name", name, by_name), ("full_event", event, by_event)):
        for query in queries.values():
            one = rounded(query(key))
            part = rounded(query().filter(F.col(column) == key))
            assert sorted(map(str, one.collect())) == sorted(map(str, part.collect()))
            assert one.count() > 0


INVARIANT = {
    "density": hs.density,
    "event_overview": hs.event_overview,
    "competitor_series": hs.competitor_series,
    "latest_state": hs.latest_state,
    "totals_delta": hs.totals_delta,
}


@pytest.mark.parametrize("name", sorted(INVARIANT))
def test_results_do_not_depend_on_partitions(rows, name):
    query = INVARIANT[name]
    one = rounded(query(rows.coalesce(1)))
    many = rounded(query(rows.repartition(40, F.rand(5))))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
