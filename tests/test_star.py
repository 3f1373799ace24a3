"""The source tables made from the given tables: how their rows move."""

from pyspark.sql import functions as F

from checks import binding
from heatsheet.operators.joins import lookup


def _star_folder(spark, path):
    """Few lines, orders and customers; a month has two orders, and a line comes twice."""
    lines = [(k, k % 3, n, 1.0 * k, 10.0 * k) for k in range(1, 40) for n in (1, 2, 2)]
    orders = [(k, k % 5, "O", 30.0 * k, f"1996-{k % 4 + 1:02d}-10") for k in range(1, 40)] + [(40, None, "P", None, None)]
    frames = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"),
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string")
        .withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")),
        "customer": spark.createDataFrame([(k, f"C{k}") for k in range(30)], "c_custkey long, c_name string"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return binding.star_tables(spark, str(path))


def test_months_are_averaged_without_a_sort_of_the_orders(spark, tmp_path):
    competitions = _star_folder(spark, tmp_path)["competitions"]
    assert "Sort" not in competitions._jdf.queryExecution().executedPlan().toString()
    found = {r.competition_id: tuple(r)[1:] for r in competitions.collect()}
    assert found["-1996-02"][:3] == ("Open 1996-02", "1996-02", "1996-02-15")
    mean = sum(30.0 * k for k in range(1, 40, 4)) / 10
    assert set(found) == {None, "1996-01", "-1996-02", "1996-03", "1996-04"}
    assert found["-1996-02"][3] == round(mean / 100000, 4) and found[None] == (None, None, None, None, "x")


def test_teams_move_once_for_themselves_and_the_join_by_entry(spark, tmp_path):
    tables = _star_folder(spark, tmp_path)
    teams = tables["entry_competitors"]
    assert teams.count() == 39 * 2
    joined = lookup(tables["competition_entries"], teams, ["entry_id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 2
