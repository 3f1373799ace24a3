import logging

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import heatsheet as hs
from heatsheet import schema
from heatsheet import scratch
from heatsheet.sources import files, sheets
from helpers import facts, listed


def test_load_tables_is_strict_unless_optional(spark, tmp_path, caplog):
    spark.range(3).write.parquet(str(tmp_path / "competitors"))
    assert hs.load_tables(spark, str(tmp_path), ["competitors"])["competitors"].count() == 3
    with pytest.raises(AnalysisException):
        hs.load_tables(spark, str(tmp_path), ["competitors", "competitions"])
    with caplog.at_level(logging.WARNING):
        tables = hs.load_tables(spark, str(tmp_path), ["competitors"], optional=["competitions"])
    assert tables["competitions"].schema == schema.SOURCES["competitions"]
    assert tables["competitions"].count() == 0 and "competitions" in caplog.text


def test_load_tables_from_text_and_catalog(spark, tmp_path):
    (tmp_path / "competitors.csv").write_text("display_name,competitor_id\nAnn,007\n")
    read = hs.load_tables(spark, str(tmp_path), ["competitors"], format="csv", layout="{name}.csv")
    read = read["competitors"]
    assert read.first().asDict() == {"display_name": "Ann", "competitor_id": "007"}
    read.createOrReplaceTempView("competitors")
    assert hs.load_tables(spark, None, ["competitors"])["competitors"].count() == 1
    with pytest.raises(AnalysisException):
        hs.load_tables(spark, None, ["no_such_table"])


def test_fact_from_text_tables_and_a_missing_one(spark, tmp_path):
    texts = {
        "competition_entries": (
            "rank_in_competition,entry_id,competition_id,completion_time_seconds,pieces_value,"
            "remaining_value,time_value\n1,e1,c1,3600,500,,1:00:00\n"
        ),
        "competitions": (
            "competition_date,competition_id,competition_name,source_tab_name,"
            "event_strength_rating\n2024-01-05,c1,Open,one,1.5\n"
        ),
        "entry_competitors": "competitor_id,entry_id\np1,e1\n",
        "competitors": "display_name,competitor_id\nAnn,p1\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    tables = hs.load_tables(
        spark, str(tmp_path), texts, ["player_event_metrics"], "csv", "{name}.csv"
    )
    fact = hs.build_results(tables)
    assert fact.schema == schema.RESULTS
    one = fact.first()
    assert (one.name, one.date.isoformat(), one.seconds, one.ppm) == ("Ann", "2024-01-05", 3600, 500 / 60)
    assert (one.rank, one.event_strength, one.latest_rating, one.total_events) == (1, 1.5, None, 1)


def test_fact_round_trip_keeps_one_size_class(spark, tmp_path):
    rows = facts(spark, [{"pieces": p} for p in (500.0, 1000.0, None)])
    path = str(tmp_path / "fact")
    hs.write_results(rows, path)
    assert listed(hs.load_results(spark, path), "entry_id") == [(0,), (2,)]
    assert hs.load_results(spark, path, pieces=None).count() == 3
    scan = hs.load_results(spark, path).select("entry_id")._jdf.queryExecution().executedPlan()
    assert "Or(EqualTo(pieces,500.0),IsNull(pieces))" in scan.toString()
    assert "ReadSchema: struct<entry_id:bigint,pieces:double>" in scan.toString()


def test_csv_and_ranking_round_trip(spark, tmp_path):
    rows = facts(spark, [{"name": "A, B", "seconds": 5}])
    hs.write_results_csv(rows, str(tmp_path / "csv"))
    back = spark.read.csv(hs.current_path(spark, str(tmp_path / "csv")), header=True).first()
    assert (back["name"], back["seconds"], back["rank"]) == ("A, B", "5.0", None)
    ranking = hs.rankings(rows, "2024-01-01", 1)
    hs.write_rankings(ranking, str(tmp_path / "ranking"))
    assert hs.load_rankings(spark, str(tmp_path / "ranking")).columns == ranking.columns


def test_union_of_sheets(spark, tmp_path):
    (tmp_path / "Spring + 24%.csv").write_text(
        "event,name,time\nSpring Open,Ann,1:00:00\n,Bob,2:00:00\n"
    )
    (tmp_path / "Autumn.csv").write_text("name,event,extra\nAnn,Autumn Open,1\nBob,Later title,2\n")
    (tmp_path / "Winter.csv").write_text("name,event,extra\nCy,Winter Open,3\n")
    (tmp_path / "_Notes.csv").write_text("a,b\n1,2\n")
    paths = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    sheets = hs.union_sources(spark, paths, exclude=["_Notes"])
    assert set(sheets.columns) == {"event", "name", "time", "extra", "source", "row_no"}
    tagged = hs.drop_if_present(hs.tag_source(sheets), "extra", "never there")
    found = {(r.event, r.name, r.full_event, r.time) for r in tagged.collect()}
    assert found == {
        ("Spring + 24%", "Ann", "Spring Open", "1:00:00"),
        ("Spring + 24%", "Bob", "Spring Open", "2:00:00"),
        ("Autumn", "Ann", "Autumn Open", None),
        ("Autumn", "Bob", "Autumn Open", None),
        ("Winter", "Cy", "Winter Open", None),
    }
    with pytest.raises(ValueError):
        hs.union_sources(spark, paths[-1:], exclude=["_Notes", "Winter"])


def test_settled_tables_live_in_the_shared_folder(spark):
    kept = hs.settle(spark.range(5))
    assert kept.count() == 5
    folder = scratch._folder(spark)
    assert all(folder in path for path in kept.inputFiles())
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or folder.startswith(shared)


def test_year_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "fact")
    rows = facts(spark, [{"name": "A", "date": f"2024-0{m}-01", "entry_id": m} for m in range(1, 9)])
    hs.write_results(rows, path, cluster_by=["date", "entry_id"])
    recent = hs.trailing(hs.load_results(spark, path), "2024-08-01", months=2)
    plan = recent.groupBy("name").count()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2024-06-01)" in plan
    assert "ReadSchema: struct<name:string,date:date,pieces:double>" in plan
    assert recent.count() == 3


def test_all_tables_of_a_folder_and_of_the_catalog(spark, tmp_path):
    for name in ("competitors", "other"):
        spark.range(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "notes.txt").write_text("x")
    assert hs.list_tables(spark, str(tmp_path), "{name}.parquet") == ["competitors", "other"]
    tables = hs.load_tables(spark, str(tmp_path), layout="{name}.parquet")
    assert {n: t.count() for n, t in tables.items()} == {"competitors": 2, "other": 2}
    spark.range(4).createOrReplaceTempView("listed_here")
    assert "listed_here" in hs.list_tables(spark, None)
    assert hs.load_tables(spark, None)["listed_here"].count() == 4


def test_broken_files_are_logged_and_others_go_on(spark, tmp_path, caplog):
    for name in ("competitors", "competitions", "unknown"):
        spark.range(1000).repartition(3).write.parquet(str(tmp_path / name))
    for name in ("competitions", "unknown"):
        part = sorted((tmp_path / name).glob("part-*.parquet"))[-1]
        part.write_bytes(part.read_bytes()[:-20])
        (part.parent / f".{part.name}.crc").unlink()
    with caplog.at_level(logging.WARNING):
        tables = hs.load_tables(spark, str(tmp_path))
    assert tables["competitors"].count() == 1000
    assert tables["competitions"].count() == 0 and "unknown" not in tables
    assert "competitions" in caplog.text and "unknown" in caplog.text


def test_a_failing_write_leaves_the_last_table(spark, tmp_path):
    path = str(tmp_path / "fact")
    hs.write_results(facts(spark, [{"name": "old"}]), path)
    broken = facts(spark, [{"name": "new"}]).withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        hs.write_results(broken, path)
    assert [r["name"] for r in hs.load_results(spark, path).collect()] == ["old"]
    assert len(files.list_folder(spark, path)) == 1
    reader = hs.load_results(spark, path)
    hs.write_results(facts(spark, [{"name": "new"}]), path)
    assert [r["name"] for r in reader.collect()] == ["old"]  # began before the switch
    assert [r["name"] for r in hs.load_results(spark, path).collect()] == ["new"]
    for i in range(3):
        hs.write_results(facts(spark, [{"name": str(i)}]), path)
    assert len(files.list_folder(spark, path)) == 1 + files.KEPT_VERSIONS
    assert hs.load_results(spark, path).first()["name"] == "2"


def test_a_table_that_is_no_ranking_is_refused(spark, tmp_path):
    hs.write_rankings(spark.range(3).withColumnRenamed("id", "name"), str(tmp_path / "r"))
    with pytest.raises(ValueError, match="name, eligible_attempts"):
        hs.load_rankings(spark, str(tmp_path / "r"))


def test_headers_of_many_sheets_take_one_job(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for n in (3, 30):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"s{i}.csv").write_text(f'event,"na""me, x",{"time" if i % 2 else "Time2"}\nT{i},A,1:00:00\n')
        (folder / "empty.csv").write_text("")
        spark.sparkContext.setJobGroup(f"sheets{n}", "")
        made = hs.union_sources(spark, [str(p) for p in folder.glob("*.csv")])
        jobs[n] = len(tracker.getJobIdsForGroup(f"sheets{n}"))
        assert made.count() == n and {'na"me, x', "time", "Time2", "source"} <= set(made.columns)
    spark.sparkContext.setJobGroup("", "")
    assert jobs[3] == jobs[30]


def test_sheets_in_folders_and_parquet(spark, tmp_path):
    rows = spark.createDataFrame([("A b", "Open", "x"), ("C", "Close", "y")], "sheet string, event string, name string")
    for name in ("A b", "C"):
        rows.filter(F.col("sheet") == name).drop("sheet").write.option("header", True).csv(str(tmp_path / "csv" / name))
    made = hs.union_sources(spark, [f"{tmp_path}/csv/{n}" for n in ("A b", "C")], named_by="folder")
    assert {(r["source"], r["event"], r["name"]) for r in made.collect()} == {("A b", "Open", "x"), ("C", "Close", "y")}
    rows.write.parquet(str(tmp_path / "p" / "one.parquet"))
    spark.createDataFrame([("Z", 1)], "event string, extra int").write.parquet(str(tmp_path / "p" / "two.parquet"))
    merged = hs.union_sources(spark, [f"{tmp_path}/p/{n}.parquet" for n in ("one", "two")], format="parquet")
    assert merged.count() == 3 and {"sheet", "event", "extra"} <= set(merged.columns)


def test_names_in_headers():
    assert sheets._columns("a,,A,b", ",", '"') == ("a0", "_c1", "A2", "b")


def test_entries_in_buckets_join_without_a_shuffle(spark):
    entries = spark.createDataFrame([(f"e{i}", f"c{i % 3}") for i in range(50)], "entry_id string, competition_id string")
    teams = spark.createDataFrame([(f"e{i // 2}", f"p{i % 7}") for i in range(80)], "entry_id string, competitor_id string")
    stored = hs.bucket_sources({"competition_entries": entries, "entry_competitors": teams, "competitors": teams}, 4)
    assert stored["competitors"] is teams
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = stored["competition_entries"].join(stored["entry_competitors"], "entry_id", "left")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = entries.join(teams, "entry_id", "left")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


def test_buckets_are_written_by_more_tasks_than_there_are_buckets(spark, tmp_path):
    entries = spark.createDataFrame([(f"e{i}", i) for i in range(200)], "entry_id string, n int")
    teams = spark.createDataFrame([(f"e{i}", f"p{i % 7}") for i in range(200)], "entry_id string, competitor_id string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for usual, files in ((8, 8), (5, 6)):
            spark.conf.set("spark.sql.shuffle.partitions", str(usual))
            path = tmp_path / str(usual)
            stored = hs.bucket_sources({"competition_entries": entries, "entry_competitors": teams}, 2, str(path))
            assert stored["competition_entries"].count() == stored["entry_competitors"].count() == 200
            parts = [p.name for p in (path / "entry_competitors").glob("part-*")]
            assert len(parts) == files and {p.split("_")[1][:5] for p in parts} == {"00000", "00001"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
