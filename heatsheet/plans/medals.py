"""Medal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import medal
from ..settings import TOP_ROWS

_MEDALS = {"gold": 1, "silver": 2, "bronze": 3}


def top_medalists(df: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """The ``n`` competitors with most first to third places."""
    placed = df.filter(F.col("rank").isin(*_MEDALS.values()) & F.col("name").isNotNull())
    counts = placed.groupBy("name").agg(
        *[F.sum(medal(F.col("rank"), place)).alias(c) for c, place in _MEDALS.items()]
    )
    total = F.col("gold") + F.col("silver") + F.col("bronze")
    return counts.orderBy(total.desc(), "name").limit(n)


def medal_long(table: DataFrame) -> DataFrame:
    """One row per competitor and kind of medal."""
    return table.unpivot("name", list(_MEDALS), "medal", "medals")
