"""Operators along the days of one key: moving average, day labels, spread dates.

A key may have any number of rows, but it has few distinct days. So rows are first summed
per (key, day); windows over the days of a key see those sums only. What depends on
the order inside one day comes from ``running_before``, which splits a crowded day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import day_label
from ..settings import AVERAGE_DAYS, LABEL_LETTERS, ONE_TASK_ROWS
from .joins import lookup_figures
from .ordering import running_before

_START, _NOW = Window.unboundedPreceding, Window.currentRow


def timeline(
    df: DataFrame,
    value: str,
    key: str = "name",
    date: str = "date",
    order: str = "entry_id",
    days: int = AVERAGE_DAYS,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add ``moving_average``, ``label``, ``day_label`` and ``spread_date`` to dated rows.

    * ``moving_average``: mean of the known values in the ``days`` days up to the row, the
      first day left out; of the row's own day only rows up to itself count.
    * ``day_label``: the day as text. ``label`` adds (a), (b), ... to repeats of a day; the
      27th and later repeats are numbered.
    * ``spread_date``: the day, moved forward until no earlier row of the key has it.

    Keys and dates must be known.
    """
    known = F.col(value).isNotNull().cast("bigint")
    amount = F.coalesce(F.col(value), F.lit(0))

    per_day = df.groupBy(key, date).agg(
        F.sum(amount).alias("__day_sum"),
        F.sum(known).alias("__day_known"),
        F.count(F.lit(1)).alias("__day_rows"),
    )
    day = F.unix_date(date)
    in_order = Window.partitionBy(key).orderBy(day)
    recent = in_order.rangeBetween(1 - days, -1)
    so_far = in_order.rowsBetween(_START, _NOW)
    placed = per_day.select(
        key,
        date,
        _or_zero(F.sum("__day_sum").over(recent)).alias("__prior_sum"),
        _or_zero(F.sum("__day_known").over(recent)).alias("__prior_known"),
        _or_zero(F.sum("__day_rows").over(in_order.rowsBetween(_START, -1))).alias("__earlier"),
    ).withColumn("__slack", F.max(day - F.col("__earlier")).over(so_far))

    inside = running_before(
        df,
        {"__peers": F.lit(1), "__peer_sum": amount, "__peer_known": known},
        [F.col(order).asc_nulls_last()],
        [key, date],
        one_task_rows,
    )
    rows = lookup_figures(inside, placed, [key, date])

    total = F.col("__prior_sum") + F.col("__peer_sum") + amount
    count = F.col("__prior_known") + F.col("__peer_known") + known
    # A day has ``earlier`` rows of its key before it. The row with ``peers`` rows before it
    # on the same day stands ``peers`` days after the first free day.
    spread = F.col("__slack") + F.col("__earlier") + F.col("__peers")
    return rows.select(
        *df.columns,
        F.try_divide(total.cast("double"), count).alias("moving_average"),
        day_label(F.col(date)).alias("day_label"),
        F.concat(day_label(F.col(date)), _suffix(F.col("__peers"))).alias("label"),
        F.date_from_unix_date(spread.cast("int")).alias("spread_date"),
    )


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def _suffix(repeat: Column) -> Column:
    letter = F.char(F.lit(ord("a") - 1) + repeat)
    mark = F.when(repeat <= LABEL_LETTERS, letter).otherwise(repeat.cast("string"))
    return F.when(repeat == 0, F.lit("")).otherwise(F.concat(F.lit(" ("), mark, F.lit(")")))


def moving_average(
    df: DataFrame,
    key: str,
    date: str,
    value: str,
    days: int = AVERAGE_DAYS,
    order: str = "entry_id",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """The rows with their ``moving_average``."""
    return timeline(df, value, key, date, order, days, one_task_rows).drop(
        "day_label", "label", "spread_date"
    )


def label_days(
    df: DataFrame,
    key: str = "name",
    date: str = "date",
    order: str = "entry_id",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """The rows with a ``label`` that is unique inside the key."""
    peers = running_before(
        df, {"__peers": F.lit(1)}, [F.col(order).asc_nulls_last()], [key, date], one_task_rows
    )
    label = F.concat(day_label(F.col(date)), _suffix(F.col("__peers")))
    return peers.select(*df.columns, label.alias("label"))


def spread_dates(
    df: DataFrame,
    key: str = "name",
    date: str = "date",
    order: str = "entry_id",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """The rows with a ``spread_date`` that is unique inside the key."""
    marked = df.withColumn("__none", F.lit(0))
    return timeline(marked, "__none", key, date, order, 1, one_task_rows).drop(
        "__none", "day_label", "label", "moving_average"
    )


def cumulative(firsts: DataFrame, out: str) -> DataFrame:
    """Running number of rows by date.

    The window has no keys: it runs over one row per calendar day, after counting.
    """
    per_day = firsts.groupBy("date").agg(F.count(F.lit(1)).alias("__new"))
    so_far = Window.orderBy("date").rowsBetween(_START, _NOW)
    return per_day.select("date", F.sum("__new").over(so_far).alias(out))
