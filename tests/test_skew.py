"""A key with a third of all rows is split in the join that looks up its figures."""

import pytest
from pyspark.sql import functions as F

import heatsheet as hs
from heatsheet.plans.refresh import with_competitor_totals

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def few_bytes_are_much(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key in SETTINGS:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 5000)
    return hs.settle(
        spark.range(150_000).select(
            F.col("id").alias("entry_id"),
            key.alias("competitor_id"),
            F.concat(F.lit("N"), key.cast("string")).alias("name"),
            F.date_add(F.lit("2024-01-01"), (F.col("id") % 90).cast("int")).alias("date"),
            F.rand(4).alias("rating_out"),
        )
    )


QUERIES = {
    "trailing_per_key": lambda rows: hs.trailing_per_key(rows, "name", 100),
    "having_count": lambda rows: hs.having_count(rows, "name", 5),
    "competitor_totals": with_competitor_totals,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hot_key_is_split(rows, few_bytes_are_much, name):
    found = QUERIES[name](rows)
    execution = found._jdf.queryExecution()
    split_rows = execution.toRdd().count()
    assert "SortMergeJoin(skew=true)" in execution.executedPlan().toString()
    assert split_rows > 50_000
