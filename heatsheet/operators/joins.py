"""One join for all lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import settle


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    null_safe: bool = False,
    how: str = "left",
) -> DataFrame:
    """Join the columns of ``table`` to ``rows`` on equally named keys.

    Left unhinted on purpose: Spark decides by size whether to broadcast the table. With
    ``null_safe`` a missing key matches a missing key.
    """
    renamed = table.select(
        *[F.col(c).alias(f"__{c}" if c in on else c) for c in table.columns]
    )
    equal = [
        F.col(c).eqNullSafe(F.col(f"__{c}")) if null_safe else F.col(c) == F.col(f"__{c}")
        for c in on
    ]
    joined = rows.join(renamed, reduce(and_, equal), how)
    return joined.drop(*[f"__{c}" for c in on])


def lookup_figures(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    null_safe: bool = False,
    how: str = "left",
) -> DataFrame:
    """``lookup`` of figures per key, where a key may have any number of rows.

    The table is settled first. A small one is then broadcast by its real size. With a
    large one, both sides of the join come straight from a shuffle, and only then does
    Spark split a skewed key of ``rows`` at run time: an aggregate between the shuffle and
    the join would forbid it.
    """
    return lookup(rows, settle(table), on, null_safe, how)
