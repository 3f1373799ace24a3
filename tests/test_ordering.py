"""The way for huge groups gives the same rows as plain windows."""

import random

import pytest
from pyspark.sql import functions as F

import heatsheet as hs
from heatsheet.operators.ordering import quantiles, range_parts, running_before, with_position, with_rank
from heatsheet.settings import FIRST_RANGE_PARTS, ONE_TASK_ROWS, RANGE_PART_ROWS

METHODS = ["min", "dense", "average", "percent"]
SMALL = 300  # rows one task may order: fewer than the hot group has, more than the others


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, one value a third of those; with unknowns."""
    dice = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else dice.choice(["a", "b", "c", None])
        value = 5.0 if dice.random() < 0.33 else round(dice.uniform(0, 50), 1)
        rows.append((i, key, None if dice.random() < 0.05 else value))
    return hs.settle(spark.createDataFrame(rows, "id bigint, key string, x double"))


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("by", [[], ["key"]])
@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(skewed, by, method, descending):
    plain = with_rank(skewed, "r", "x", by, method, descending)
    split = with_rank(skewed, "r", "x", by, method, descending, one_task_rows=SMALL)
    assert _rows(plain) == _rows(split)
    assert dict(plain.dtypes)["r"] == dict(split.dtypes)["r"]


@pytest.mark.parametrize("by", [[], ["key"]])
def test_positions(skewed, by):
    order = [F.col("x").asc_nulls_last(), F.col("id")]
    plain = with_position(skewed, "p", order, by)
    split = with_position(skewed, "p", order, by, one_task_rows=SMALL)
    assert _rows(plain) == _rows(split)


@pytest.mark.parametrize("by", [[], ["key"]])
def test_running_sums(skewed, by):
    sums = {"n": F.lit(1), "total": F.coalesce(F.col("id"), F.lit(0))}
    order = [F.col("id").desc()]
    assert _rows(running_before(skewed, sums, order, by)) == _rows(
        running_before(skewed, sums, order, by, one_task_rows=SMALL)
    )


def test_only_the_hot_group_is_split(skewed):
    sizes = {r.key: r["count"] for r in skewed.groupBy("key").count().collect()}
    assert [k for k, n in sizes.items() if n > SMALL] == ["hot"]
    split = with_position(skewed, "p", [F.col("id")], ["key"], one_task_rows=SMALL)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert sum("windowspecdefinition(__part" in line for line in windows) == 1
    placed = [path for path in split.inputFiles()]
    assert len(placed) > 1
    whole = with_position(skewed, "p", [F.col("id")], [], one_task_rows=SMALL)
    assert "Join LeftAnti" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_against_pandas(skewed):
    wanted = skewed.toPandas().groupby("key", dropna=False)["x"].quantile([0.25, 0.5, 0.75])
    for limit in (10_000, SMALL):
        found = quantiles(skewed, "x", {"a": 0.25, "b": 0.5, "c": 0.75}, ["key"], limit)
        for row in found.collect():
            expected = wanted[float("nan") if row.key is None else row.key]
            assert [row.a, row.b, row.c] == pytest.approx(list(expected))


def test_documented_ranks(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 1.0, None, 2.0])],
                                  "i int, v double")
    wanted = {
        "percent": [100.0, 37.5, 37.5, None, 75.0],
        "min": [4, 1, 1, None, 3],
        "dense": [3, 1, 1, None, 2],
    }
    for method, ranks in wanted.items():
        for limit in (1000, 2):
            found = with_rank(frame, "r", "v", [], method, one_task_rows=limit).orderBy("i")
            assert [r.r for r in found.collect()] == ranks


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_ranking_does_not_depend_on_partitions(spark, sf_dir, partitions):
    from checks import binding

    rows = binding.results(spark, sf_dir)
    wanted = _rows(binding.ranking(spark, sf_dir))
    again = binding.build_ranking(rows.repartition(partitions))
    found = _rows(again)
    assert [r[:1] + r[2:] for r in found] == [r[:1] + r[2:] for r in wanted]
    assert [r[0] for r in found] == pytest.approx([r[0] for r in wanted])


SPLIT_QUERIES = {
    "rankings": lambda rows, limit: hs.rankings(
        rows, hs.latest_date(rows), 3, 10, True, one_task_rows=limit
    ),
    "event_stats": lambda rows, limit: hs.event_stats(rows, one_task_rows=limit),
    "score_attempts": lambda rows, limit: hs.score_attempts(rows, one_task_rows=limit).select(
        "entry_id", "z", "percentile", "event_timed"
    ),
    "event_overview": lambda rows, limit: hs.event_overview(rows, one_task_rows=limit),
    "performance_curve": lambda rows, limit: hs.performance_curve(rows, one_task_rows=limit),
    "leaderboard": lambda rows, limit: hs.leaderboard(rows, one_task_rows=limit),
    "competitor_series": lambda rows, limit: hs.competitor_series(rows, one_task_rows=limit),
    "ordered_attempts": lambda rows, limit: hs.ordered_attempts(rows, None, one_task_rows=limit),
    "repair_ranks": lambda rows, limit: hs.repair_ranks(
        rows, ["1997-03|1-URGENT", "1998-05|5-LOW"], one_task_rows=limit
    ).select("entry_id", "rank"),
    "attempt_boxes": lambda rows, limit: hs.five_number(
        hs.with_attempt_number(rows, one_task_rows=limit), "full_event", "attempt_number", limit
    ),
}


@pytest.mark.parametrize("name", sorted(SPLIT_QUERIES))
def test_queries_take_the_split_way_alike(spark, sf_dir, name):
    from checks import binding
    from checks.registry import rounded

    # A third of the rows goes to one name and to one event.
    hot = F.col("entry_id") % 3 == 0
    rows = binding.results(spark, sf_dir).withColumns(
        {
            "name": F.when(hot, F.lit("Hot")).otherwise(F.col("name")),
            "event": F.when(hot, F.lit("hot")).otherwise(F.col("event")),
            "full_event": F.when(hot, F.lit("Open hot")).otherwise(F.col("full_event")),
        }
    )
    query = SPLIT_QUERIES[name]
    assert _rows(rounded(query(rows, 10**9))) == _rows(rounded(query(rows, 1500)))


def test_range_partitions_are_no_more_than_pay():
    assert range_parts(20, 10) == 4
    # rows that a few tasks sort at once are not dealt to thousands of them
    assert range_parts(135_000, 10) == FIRST_RANGE_PARTS
    assert range_parts(50_000_000, 10) == 50_000_000 // RANGE_PART_ROWS
    assert range_parts(10 * ONE_TASK_ROWS, ONE_TASK_ROWS) == 20
