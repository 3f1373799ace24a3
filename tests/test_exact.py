"""Fractions of a second, densities and quantiles against plain arithmetic."""

from fractions import Fraction
from math import exp, pi, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

import heatsheet as hs
from heatsheet.functions import measures
from heatsheet.operators.ordering import quantiles, with_percent_ranks, with_rank
from helpers import facts


@pytest.fixture(scope="module")
def times(spark):
    rng = np.random.default_rng(11)
    rows = [
        {"name": f"n{i % 7}", "full_event": f"e{i % 3}", "event": f"e{i % 3}", "date": f"2024-01-{i % 28 + 1:02d}", "seconds": round(float(x), 3)}
        for i, x in enumerate(rng.gamma(4, 1200, 600))
    ]
    return facts(spark, [*rows, {"name": "n1", "full_event": "e1"}, {"name": "alone", "full_event": "single", "seconds": 100.7}])


def test_fraction_stays_in_the_fact_and_in_sums(spark, times):
    assert times.filter("name = 'alone'").first()["seconds"] == 100.7
    exact = sum((Fraction(str(r["seconds"])) for r in times.collect() if r["seconds"] is not None), Fraction(0))
    found = {hs.totals(times.repartition(n, "entry_id")).first()["seconds"] for n in (1, 2, 5, 13)}
    assert found == {float(exact)}
    for query in (hs.event_overview, hs.competitor_stats, hs.event_detail):
        made = {tuple(sorted(map(str, query(times.repartition(n)).collect()))) for n in (1, 7)}
        assert len(made) == 1, query


def test_exact_sum_of_large_and_odd_values(spark):
    rows = [(1e11 + 0.1,), (0.2,), (None,), (-0.3,), (5e-7,)]
    made = spark.createDataFrame(rows, "s double").agg(measures.exact_sum(F.col("s")).alias("sum"), measures.exact_mean(F.col("s")).alias("mean")).first()
    assert made["sum"] == pytest.approx(1e11, abs=1e-4) and made["mean"] == pytest.approx(2.5e10, abs=1e-4)
    none = spark.createDataFrame([], "s double").agg(measures.exact_mean(F.col("s")).alias("m"))
    assert none.first()["m"] is None


def curve(x, grid):
    h = np.std(x, ddof=1) * len(x) ** -0.2
    return np.array([sum(exp(-0.5 * ((g - v) / h) ** 2) for v in x) for g in grid]) / (len(x) * h * sqrt(2 * pi))


def test_density_is_the_sum_of_kernels(times):
    rows = times.filter("seconds is not null").select("full_event", "seconds").collect()
    grid = np.linspace(0, 5, 101)
    every = np.array([r["seconds"] / 3600 for r in rows])
    whole = curve(every[every <= 5], grid)
    made = {}
    for r in hs.density(times, points=101).collect():
        made.setdefault(r["full_event"], {})[r["point"]] = (r["y_all"], r["y_event"])
    assert set(made) == {"e0", "e1", "e2"}
    for event, points in made.items():
        own = curve([x for r in rows if r["full_event"] == event and (x := r["seconds"] / 3600) <= 5], grid)
        got = np.array([points[i] for i in range(101)])
        assert got[:, 0] == pytest.approx(whole, abs=1e-9)
        assert got[:, 1] == pytest.approx(own * whole.max() / own.max(), abs=1e-9)


def test_density_of_close_times_is_zero_beyond_reach(spark):
    rows = [{"full_event": "a", "seconds": 3600 + i / 10} for i in range(50)] + [{"full_event": "b", "seconds": 9000 + i} for i in range(5)]
    made = hs.density(facts(spark, rows)).filter("full_event = 'a'").collect()
    assert len(made) == 500
    assert {r["y_event"] for r in made if abs(r["x"] - 1) > 0.2} == {0.0}
    assert max(r["y_event"] for r in made) > 0


def test_work_of_the_density_follows_slices_not_settings(spark, times):
    counts = set()
    for partitions in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = hs.density(times).orderBy("full_event", "point").collect()
        counts.add(tuple((r["full_event"], r["point"], round(r["y_event"], 9)) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(counts) == 1


@pytest.mark.parametrize("limit", [10_000, 20])
def test_quantiles_with_other_figures(spark, times, limit):
    rows = times.select("event", "seconds").unionByName(spark.createDataFrame([("none", None)] * 30 + [("same", 5.0)] * 40, "event string, seconds double"))
    known = rows.filter("event is not null")
    made = quantiles(known, "seconds", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 1.0}, ["event"], limit, beside={"n": F.count("seconds"), "mean": F.avg("seconds")})
    made = {r["event"]: r for r in made.collect()}
    by_event = {}
    for r in known.collect():
        by_event.setdefault(r["event"], []).append(r["seconds"])
    assert set(made) == set(by_event)
    for event, values in by_event.items():
        x = [v for v in values if v is not None]
        assert made[event]["n"] == len(x)
        want = np.quantile(x, [0, 0.1, 0.5, 1]) if x else [None] * 4
        assert [made[event][c] for c in "abcd"] == (pytest.approx(list(want)) if x else want)


@pytest.mark.parametrize("limit", [10_000, 20])
def test_percent_ranks_of_several_columns(spark, times, limit):
    rows = times.select("entry_id", "seconds", F.length("name").alias("letters"))
    made = with_percent_ranks(rows, {"seconds": "s", "letters": "l"}, limit).orderBy("entry_id").collect()
    for column, out in (("seconds", "s"), ("letters", "l")):
        want = with_rank(rows, out, column, [], "percent").orderBy("entry_id").collect()
        assert [r[out] for r in made] == pytest.approx([r[out] for r in want], nan_ok=True)


def test_ranks_of_all_columns_take_one_exchange(spark, monkeypatch):
    from heatsheet.operators import ordering

    plans, settled = [], ordering.settle
    monkeypatch.setattr(ordering, "settle", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settled(df))[1])
    rows = spark.createDataFrame([(float(i), i % 5, i % 3) for i in range(100)], "a double, b int, c int")
    with_percent_ranks(rows, {"a": "x", "b": "y", "c": "z"})
    ranks = [p for p in plans if "__ahead" in p]
    assert len(ranks) == 1 and ranks[0].count("Window [") == 1
    assert ranks[0].count("Exchange hashpartitioning(__column") == 2  # ranks, and the sizes of the columns
