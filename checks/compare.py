"""Runs queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from . import registry, sql


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("heatsheet")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
}


def compare(spark: SparkSession, db, name: str, sf_dir: str) -> list[str]:
    """Differences between a query and its SQL; empty when they agree."""
    found = registry.queries()[name](spark, sf_dir)
    wanted = db.execute(sql.oracle_sql()[name])
    wanted_columns = [d[0] for d in wanted.description]
    wanted_rows = wanted.fetchall()
    problems = []
    if sorted(found.columns) != sorted(wanted_columns):
        problems.append(f"columns {sorted(found.columns)} / {sorted(wanted_columns)}")
    types = db.execute(f"DESCRIBE {sql.oracle_sql()[name]}").fetchall()
    ours_typed, theirs_typed = dict(found.dtypes), {t[0]: _TYPES.get(t[1], t[1]) for t in types}
    if ours_typed != theirs_typed:
        odd = {c for c in ours_typed if ours_typed[c] != theirs_typed.get(c)}
        problems.append(f"types of {odd}")
    ours = _rows(found.columns, [tuple(r) for r in found.collect()])
    theirs = _rows(wanted_columns, wanted_rows)
    if not ours:
        problems.append("no rows")
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        problems.append(f"rows {sum(ours.values())} / {sum(theirs.values())}, differ {len(extra)}")
        problems += [f"  ours   {r}" for r in sorted(extra, key=str)[:3]]
        problems += [f"  theirs {r}" for r in sorted(missing, key=str)[:3]]
    return problems


if __name__ == "__main__":
    folder = sys.argv[1]
    spark, db = session(), database(folder)
    for name in sys.argv[2:] or registry.queries():
        start = time.time()
        try:
            problems = compare(spark, db, name, folder)
        except Exception as failure:  # report and go on with the next query
            problems = [f"{type(failure).__name__}: {str(failure)[:1500]}"]
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - start:.1f}s", flush=True)
        for line in problems:
            print("     ", line)
