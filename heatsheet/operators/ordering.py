"""Positions, ranks, running sums and quantiles that survive a huge group.

A plain window puts every row of a group, or of the whole table when it has no
keys, into one task. That is the best plan while groups are small, so each operator
first measures the largest group. Groups beyond ``one_task_rows`` are set apart and take
another way to the same result, while the others keep the window:

1. reduce the rows to distinct values with counts, where the question allows it;
2. range-partition by (keys, order), which splits a group of any size, and settle the
   result, so that partition numbers are data and cannot change any more;
3. sum inside each partition, and carry over the sums of earlier partitions. Only a
   group that crosses a partition border needs a carry, and a border is crossed by
   one group, so the broadcast carry table has fewer rows than there are partitions,
   MAX_RANGE_PARTS at most.

Every order must be total: callers end it with a unique column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import FIRST_RANGE_PARTS, MAX_RANGE_PARTS, ONE_TASK_ROWS, RANGE_PART_ROWS
from ..scratch import settle
from .joins import lookup, lookup_figures

_START, _NOW = Window.unboundedPreceding, Window.currentRow


@dataclass(frozen=True)
class GroupSizes:
    """Rows of the largest group and of the whole frame."""

    largest: int
    total: int


def group_sizes(df: DataFrame, by: list[str]) -> GroupSizes:
    """One aggregation with partial sums; two numbers reach the driver."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n"), F.sum("n")).first()
    return GroupSizes(row[0] or 0, row[1] or 0)


def by_size(
    df: DataFrame,
    by: list[str],
    one_task_rows: int,
    sizes: GroupSizes | None,
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame, GroupSizes], DataFrame],
) -> DataFrame:
    """Apply ``small`` to the rows of groups one task can order, and ``large`` to the rest.

    There are fewer than total / one_task_rows large groups. Their keys are settled, so Spark
    knows the size of that table when it decides whether to broadcast it.
    """
    sizes = sizes or group_sizes(df, by)
    if sizes.largest <= one_task_rows:
        return small(df)
    if not by:
        return large(df, sizes)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    crowded = settle(counts.filter(F.col("n") > one_task_rows))
    keys = crowded.drop("n")
    crowd = GroupSizes(sizes.largest, crowded.agg(F.sum("n")).first()[0] or 0)
    few = lookup(df, keys, by, null_safe=True, how="left_anti")
    many = lookup(df, keys, by, null_safe=True, how="left_semi")
    return small(few).unionByName(large(many, crowd))


def _directed(column: str, descending: bool) -> Column:
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def running_before(
    df: DataFrame,
    sums: dict[str, Column],
    order: list[Column],
    by: list[str] | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Add sums over the rows that precede each row in its group; 0 for the first row."""
    by = by or []

    def small(rows):
        ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(_START, -1)
        before = [_or_zero(F.sum(e).over(ahead)).alias(c) for c, e in sums.items()]
        return rows.select("*", *before)

    def large(rows, crowd):
        return _running_by_range(rows, sums, order, by, one_task_rows, crowd)

    return by_size(df, by, one_task_rows, sizes, small, large)


def range_parts(rows: int, one_task_rows: int) -> int:
    """How many range partitions: two for as many rows as one task may order, but no more tasks than pay."""
    paying = max(FIRST_RANGE_PARTS, ceil(rows / RANGE_PART_ROWS))
    return min(max(2, ceil(2 * rows / one_task_rows)), paying, MAX_RANGE_PARTS)


def _running_by_range(df, sums, order, by, one_task_rows, sizes):
    parts = range_parts(sizes.total, one_task_rows)
    addends = [e.alias(f"__add_{c}") for c, e in sums.items()]
    spread = df.select("*", *addends).repartitionByRange(parts, *by, *order)
    placed = settle(spread.withColumn("__part", F.spark_partition_id()))

    slices = placed.groupBy("__part", *by).agg(
        *[F.sum(f"__add_{c}").alias(f"__carry_{c}") for c in sums]
    )
    earlier = Window.partitionBy(*by).orderBy("__part")
    carries = slices.select(
        "__part",
        *by,
        F.row_number().over(earlier).alias("__nth"),
        *[
            F.sum(f"__carry_{c}").over(earlier.rowsBetween(_START, -1)).alias(f"__carry_{c}")
            for c in sums
        ],
    ).filter("__nth > 1").drop("__nth")

    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(_START, -1)
    local = placed.select(
        "*", *[_or_zero(F.sum(f"__add_{c}").over(inside)).alias(f"__in_{c}") for c in sums]
    )
    carried = lookup(local, F.broadcast(carries), ["__part", *by], null_safe=True)
    return carried.select(
        *df.columns,
        *[(F.col(f"__in_{c}") + _or_zero(F.col(f"__carry_{c}"))).alias(c) for c in sums],
    )


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0).cast("bigint"))


def with_position(
    df: DataFrame,
    out: str,
    order: list[Column],
    by: list[str] | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in a total order."""
    counted = running_before(df, {out: F.lit(1)}, order, by, one_task_rows, sizes)
    return counted.withColumn(out, F.col(out) + 1)


def with_rank(
    df: DataFrame,
    out: str,
    value: str,
    by: list[str] | None = None,
    method: str = "min",
    descending: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Rank rows by a value inside their group; a NULL value has a NULL rank.

    ``min`` gives ties the lowest rank, ``dense`` leaves no gaps, ``average`` gives ties
    the mean of their ranks, and ``percent`` is the average rank over the number of
    values, times 100.
    """
    if method not in ("min", "dense", "average", "percent"):
        raise ValueError(f"unknown rank method {method!r}")
    by = by or []

    def small(rows):
        return rank_by_window(rows, out, value, by, method, descending)

    def large(rows, _):
        return _rank_by_values(rows, out, value, by, method, descending, one_task_rows)

    return by_size(df, by, one_task_rows, sizes, small, large)


def rank_by_window(
    df: DataFrame, out: str, value: str, by: list[str], method: str, descending: bool = False
) -> DataFrame:
    """The ranks of ``with_rank`` by a plain window, for groups known to be small."""
    group = Window.partitionBy(*by)
    ordered = group.orderBy(_directed(value, descending))
    if method == "dense":
        rank = F.dense_rank().over(ordered).cast("bigint")
    elif method == "min":
        rank = F.rank().over(ordered).cast("bigint")
    else:
        last = F.count(F.lit(1)).over(ordered.rangeBetween(_START, _NOW))
        rank = (F.rank().over(ordered) + last) / F.lit(2.0)
        if method == "percent":
            rank = rank / F.count(value).over(group) * 100
    return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))


def _rank_by_values(df, out, value, by, method, descending, one_task_rows):
    counts = value_counts(df, value, by)
    ahead = running_before(
        counts,
        {"__ahead": F.col("n"), "__distinct": F.lit(1)},
        [_directed(value, descending)],
        by,
        one_task_rows,
    )
    average = F.col("__ahead") + (F.col("n") + 1) / F.lit(2.0)
    if method == "dense":
        rank = F.col("__distinct") + 1
    elif method == "min":
        rank = F.col("__ahead") + 1
    else:
        rank = average
    if method == "percent":
        known = counts.groupBy(*by).agg(F.sum("n").alias("__known"))
        if by:
            ahead = lookup_figures(ahead, known, by, null_safe=True)
            rank = average / F.col("__known") * 100
        else:
            rank = average / F.lit(known.first()[0] or 0) * 100
    ranks = ahead.select(*by, value, rank.alias(out))
    return lookup_figures(df, ranks, [*by, value], null_safe=True)


def value_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Distinct known values per group with their counts in ``n``, settled."""
    known = df.filter(F.col(value).isNotNull())
    return settle(known.groupBy(*(by or []), value).agg(F.count(F.lit(1)).alias("n")))


def with_percent_ranks(
    df: DataFrame,
    columns: dict[str, str],
    one_task_rows: int = ONE_TASK_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Add percentiles of several columns among all rows: ``columns`` maps a column to its new one.

    The ranks are those of ``with_rank(method="percent")``. All columns are turned into one
    table of (column, value), counted and ordered together, so the number of exchanges does
    not depend on the number of columns. Numbers are compared as doubles.
    """
    pairs = [F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__value")) for c in columns]
    stacked = df.select(F.inline(F.array(*pairs)))
    counts = value_counts(stacked, "__value", ["__column"])
    order = [F.col("__value").asc()]
    ahead = running_before(counts, {"__ahead": F.col("n")}, order, ["__column"], one_task_rows, sizes)
    known = counts.groupBy("__column").agg(F.sum("n").alias("__known"))
    percent = (F.col("__ahead") + (F.col("n") + 1) / F.lit(2.0)) / F.col("__known") * 100
    ranks = settle(lookup(ahead, F.broadcast(known), ["__column"]).select("__column", "__value", percent.alias("__percent")))
    for column, out in columns.items():
        own = ranks.filter(F.col("__column") == column).select("__value", F.col("__percent").alias(out))
        df = lookup(df.withColumn("__value", F.col(column).cast("double")), own, ["__value"]).drop("__value")
    return df


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: list[str],
    one_task_rows: int = ONE_TASK_ROWS,
    sizes: GroupSizes | None = None,
    beside: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact quantiles per group, interpolated linearly between neighbouring values.

    ``percentile`` holds all distinct values of a group in one task. Groups beyond
    ``one_task_rows`` are read twice instead: for a histogram, and for the values of the few
    bins that hold the wanted places. ``beside`` are further aggregates of the group, which
    for small groups come out of the same aggregation.
    """
    beside = beside or {}
    more = [e.alias(c) for c, e in beside.items()]

    def small(rows):
        every = F.percentile(value, list(map(float, probabilities.values()))).alias("__all")
        found = rows.groupBy(*by).agg(*more, every)
        return found.select(*by, *beside, *[F.get("__all", F.lit(i)).alias(c) for i, c in enumerate(probabilities)])

    def large(rows, _):
        picked = _quantiles_by_histogram(rows, value, probabilities, by, one_task_rows)
        every = rows.groupBy(*by).agg(*more, F.count(F.lit(1)).alias("__rows"))
        picked = lookup_figures(every, picked, by, null_safe=True)
        return picked.select(*by, *beside, *probabilities)

    return by_size(df, by, one_task_rows, sizes, small, large)


# Bins of a histogram over the values of one group.
_BINS = 4096


def _quantiles_by_histogram(df, value, probabilities, by, one_task_rows):
    known = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__value"))
    ends = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__known"), F.min("__value").alias("__low"), F.max("__value").alias("__high")
    )
    rows = lookup_figures(known, ends, by, null_safe=True, how="inner")
    share = F.coalesce(F.try_divide(F.col("__value") - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))
    bins = F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).cast("int").alias("__bin")
    rows = rows.select(*by, "__value", "__known", bins)
    histogram = settle(rows.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__n"), F.max("__known").alias("__known")))
    # at most _BINS rows a group
    earlier = Window.partitionBy(*by).orderBy("__bin").rowsBetween(_START, -1)
    histogram = histogram.withColumn("__before", _or_zero(F.sum("__n").over(earlier)))

    wanted = []
    for name, p in probabilities.items():
        place = (F.col("__known") - 1) * F.lit(float(p))
        part = place - F.floor(place)
        wanted += [
            F.struct(F.lit(name).alias("__name"), F.floor(place).alias("__place"), (1 - part).alias("__weight")),
            F.struct(F.lit(name).alias("__name"), F.ceil(place).alias("__place"), part.alias("__weight")),
        ]
    places = histogram.select(*by, "__bin", "__n", "__before", F.inline(F.array(*wanted)))
    inside = (F.col("__before") <= F.col("__place")) & (F.col("__place") < F.col("__before") + F.col("__n"))
    places = settle(places.filter(inside).select(*by, "__bin", "__name", "__place", "__weight", "__before"))

    held = lookup(rows, places.select(*by, "__bin").distinct(), [*by, "__bin"], null_safe=True, how="left_semi")
    counts = value_counts(held, "__value", [*by, "__bin"])
    ahead = running_before(counts, {"__ahead": F.col("n")}, [F.col("__value").asc()], [*by, "__bin"], one_task_rows)
    met = lookup(ahead, places, [*by, "__bin"], null_safe=True, how="inner")
    at = F.col("__place") - F.col("__before")
    found = met.filter((F.col("__ahead") <= at) & (at < F.col("__ahead") + F.col("n")))
    # a place between two values weighs both
    mean = F.sum(F.col("__value") * F.col("__weight"))
    picked = found.groupBy(*by, "__name").agg(mean.alias("__value"))
    each = [F.max(F.when(F.col("__name") == name, F.col("__value"))).alias(name) for name in probabilities]
    return picked.groupBy(*by).agg(*each)


def row_mean(*columns: str) -> Column:
    """Mean of the known values across columns; NULL when all are missing."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    known = [F.col(c).isNotNull().cast("int") for c in columns]
    return F.try_divide(reduce(add, values), reduce(add, known))
