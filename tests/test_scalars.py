import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import registry
from heatsheet.functions import clock, measures
from heatsheet.operators.ordering import row_mean
from helpers import evaluate

TEXT, REAL, LONG = T.StringType(), T.DoubleType(), T.LongType()


@pytest.mark.parametrize(
    "text, strict, lenient",
    [
        ("1:02:03", 3723, 3723),
        ("02:03", None, 123),
        ("x", None, 0),
        (None, None, 0),
        ("1:2:x", None, 0),
        ("1.5:00:00", None, 0),
        ("", None, 0),
        ("::", None, 0),
        ("1:2:3:4", None, 0),
        (" 1 : 02 :03 ", 3723, 3723),
        ("100:00:00", 360000, 360000),
        ("99999999999999999999:00:00", None, 0),
    ],
)
def test_parse(spark, text, strict, lenient):
    assert evaluate(spark, TEXT, [text], clock.parse_hms_strict) == [strict]
    assert evaluate(spark, TEXT, [text], clock.parse_hms_lenient) == [lenient]


def test_format_hms(spark):
    values = [0.0, 59.9, 3723.0, 360000.0, None]
    wanted = ["00:00:00", "00:00:59", "01:02:03", "100:00:00", None]
    assert evaluate(spark, REAL, values, clock.format_hms) == wanted
    assert evaluate(spark, REAL, [None], clock.format_hms_or_dash) == ["-"]
    assert evaluate(spark, REAL, [1.5, None], clock.format_hms_hours) == ["01:30:00", None]


def test_format_timedelta_is_python_text(spark):
    values = [0, 5, 3723, 86399, 86400, 90061, 200000, -5, -90000]
    wanted = [str(dt.timedelta(seconds=v)) for v in values]
    assert evaluate(spark, LONG, values, clock.format_timedelta) == wanted
    assert evaluate(spark, LONG, [None], clock.format_timedelta) == [None]


def test_dates(spark):
    values = ["2024-02-29", "2024-02-30", "soon", None, "2024-03-01 10:00:00"]
    wanted = [dt.date(2024, 2, 29), None, None, None, dt.date(2024, 3, 1)]
    assert evaluate(spark, TEXT, values, clock.to_day) == wanted
    label = evaluate(spark, TEXT, ["2024-02-09"], lambda c: clock.day_label(clock.to_day(c)))
    assert label == ["Feb 09, 2024"]


def _measures(spark, pieces, remaining, seconds):
    frame = spark.createDataFrame(
        [(pieces, remaining, seconds)], "p double, r double, s double"
    )
    row = frame.select(
        measures.ppm(F.col("p"), F.col("r"), F.col("s")).alias("ppm"),
        measures.time_penalty(F.col("p"), F.col("r"), F.col("s")).alias("penalty"),
    ).first()
    return row.ppm, row.penalty


def test_penalty_and_pace(spark):
    assert _measures(spark, 500.0, 0.0, 6000.0) == (5.0, 0.0)
    assert _measures(spark, 500.0, 500.0, 100.0) == (0.0, None)      # nothing placed
    assert _measures(spark, 500.0, 0.0, 0.0) == (None, 0.0)          # no time passed
    assert _measures(spark, 500.0, 600.0, 100.0)[1] == -600.0
    assert _measures(spark, 500.0, None, 100.0) == (None, None)


def test_clean_remaining(spark):
    values = [None, "1:23:45", "12:00:00", "17", "3.5", "x", "1:2:3"]
    assert evaluate(spark, TEXT, values, measures.clean_remaining) == [
        0.0, 0.0, 0.0, 17.0, 3.5, None, None,
    ]
    assert evaluate(spark, REAL, [4.0, None], measures.clean_remaining) == [4.0, 0.0]


def test_clean_text_and_numbers(spark):
    names = ["  A B\t", " x\n", None, ""]
    assert evaluate(spark, TEXT, names, measures.clean_name) == ["A B", "x", None, ""]
    numbers = ["500", " 1e3 ", "five", None, "NaN", "Infinity"]
    assert evaluate(spark, TEXT, numbers, measures.to_number) == [500, 1000, None, None, None, None]


def test_rounding_goes_to_even(spark):
    values = [0.125, 2.675, 3.0, None]
    assert evaluate(spark, REAL, values, measures.round_or_dash) == ["0.12", "2.68", "3.0", "-"]


def test_rank_of_total(spark):
    frame = spark.createDataFrame(
        [(1, 3, 12), (2, None, 12), (3, 4, None)], "i int, rank int, total bigint"
    )
    text = measures.rank_of_total(F.col("rank"), F.col("total")).alias("t")
    assert [r.t for r in frame.orderBy("i").select(text).collect()] == ["3/12", None, "4/0"]


def test_row_mean_skips_missing(spark):
    frame = spark.createDataFrame([(1, 2, 6), (1, None, 4), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in frame.select(row_mean("a", "b", "c")).collect()] == [3.0, 2.5, None]


def test_days_in_other_formats(spark):
    texts = ["8/11/2025", "Aug 11, 2025", "11 Aug 2025", "13/40/2025", "yesterday", " 2025-08-11 "]
    day = dt.date(2025, 8, 11)
    assert evaluate(spark, TEXT, texts, clock.to_day) == [day, day, day, None, None, day]


def test_numbers_in_other_shapes(spark):
    texts = ["-1.5e3", " 7 ", ".5", "5.", "1:00:00", "", "0x10"]
    assert evaluate(spark, TEXT, texts, measures.to_number) == [-1500, 7, 0.5, 5, None, None, None]


def test_dates_in_many_shapes(spark):
    day = __import__("datetime").date(2025, 8, 11)
    good = [
        "8/11/2025", "08/11/2025", "2025/08/11", "2025-08-11", "2025-08-11 23:10:00", "2025-08-11T01:02:03", "08-11-2025",
        "Aug 11, 2025", "August 11, 2025", "aug 11 2025", "11 Aug 2025", "11 August 2025", "11-Aug-2025", "11.08.2025", " 2025.8.11 ",
    ]
    bad = ["", "soon", "8/11/25", "13/11/2025", "Augst 11, 2025", "An 11, 2025", "2025-13-01", "2025-08-11 later", "1/2/3/2025", "0/0/2025", "Feb 30, 2025", "8//2025"]
    assert evaluate(spark, TEXT, good, clock.to_day) == [day] * len(good)
    assert evaluate(spark, TEXT, bad, clock.to_day) == [None] * len(bad)
    rows = spark.createDataFrame([(t,) for t in ["8/11/2025", "soon", "soon", " ", None]], "d string")
    assert [tuple(r) for r in clock.unread_days(rows, "d").collect()] == [("soon", 2)]


def test_typed_dates_are_left_alone(spark):
    rows = spark.sql("SELECT DATE'2025-08-11' AS d, TIMESTAMP'2025-08-11 23:00:00' AS t")
    plan = rows.select(clock.to_day(F.col("d")), clock.to_day(F.col("t")))
    assert set(map(str, plan.first())) == {"2025-08-11"}
    table = spark.range(3).select(F.date_from_unix_date(F.col("id").cast("int")).alias("d"))
    shown = table.select(clock.to_day(F.col("d")).alias("day"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in shown and "string" not in shown


def test_doubles_are_rounded_as_round_does(spark, monkeypatch):
    some = [0.0, -0.0, 0.5, 2.5e-6, -2.5e-6, 5e-7, -5e-7, 4.9e-7, 1.0000005, 1.0000015, 0.1 + 0.2, 1 / 3, -2 / 3, 123456.7890125,
            999999.9999995, 1e6 + 1 / 3, 1e9 + 0.1234565, 1e15 + 0.3, 1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None]
    many = [i / 2e6 for i in range(-2000, 2000)] + [(i * 7919 % 100003) / 997 for i in range(4000)]
    rows = spark.createDataFrame([(v,) for v in some + many], "v double")
    both = rows.select(F.round("v", 6).cast("string"), registry._rounded(F.col("v"), 6).cast("string")).collect()
    assert [r[0] for r in both] == [r[1] for r in both]
    # the plain way is for ties and for large values alone
    monkeypatch.setattr(registry.F, "round", lambda value, places: F.lit(None).cast("double"))
    fast = rows.select(F.sum(registry._rounded(F.col("v"), 6).isNotNull().cast("int"))).first()[0]
    assert fast > len(many) / 2
