"""Building the result fact from source tables or from event sheets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import clock, measures
from ..operators.joins import lookup, lookup_figures
from ..operators.ordering import with_rank
from ..settings import ONE_TASK_ROWS
from ..scratch import settle
from ..sources.sheets import drop_if_present, tag_source

_IDS = ("entry_id", "competitor_id")
_KEYS = ("entry_id", "competition_id", "competitor_id")


# The tables in the order in which they own columns, and what joins them to the entries.
_JOIN_KEYS = {
    "competition_entries": ["entry_id", "competition_id"],
    "competitions": ["competition_id"],
    "entry_competitors": ["entry_id"],
    "competitors": ["competitor_id"],
    "player_event_metrics": ["competitor_id", "competition_id"],
}


def _whole(column: Column) -> Column:
    return column.try_cast("int")


# Source column -> column of the fact, and how it is read.
_READINGS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "display_name": ("name", lambda c: c),
    "source_tab_name": ("event", lambda c: c),
    "competition_name": ("full_event", lambda c: c),
    "competition_date": ("date", clock.to_day),
    "time_value": ("time_text", lambda c: c),
    "completion_time_seconds": ("seconds", measures.to_number),
    "pieces_value": ("pieces", measures.to_number),
    "remaining_value": ("remaining", measures.to_number),
    "rank_in_competition": ("rank", _whole),
    "rating_in": ("rating_in", measures.to_number),
    "rating_out": ("rating_out", measures.to_number),
    "event_strength_rating": ("event_strength", measures.to_number),
    "rolling_12mo_avg_completion_time": (
        "avg_12m_text",
        lambda c: clock.format_hms(measures.to_number(c)),
    ),
}


def build_results(
    tables: dict[str, DataFrame],
    repair_events: Iterable[str] = (),
    null_safe: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """The result fact from the five source tables.

    One row per (entry, competitor): a team entry has one row per member. When two
    tables bring a column of the same name, the first table in join order owns it.
    ``repair_events`` are competition ids whose official rank is replaced by the dense
    rank of the corrected time. With ``null_safe`` an unknown competitor matches another.
    """
    # Each table is read before the joins: a date is parsed once per competition, and not
    # once per result.
    read = _owned({name: _read(tables[name]) for name in _JOIN_KEYS})
    rows = read["competition_entries"]
    # Teams come first: tables that lie in buckets by entry (``bucket_sources``) meet there
    # without a shuffle, which a join by another key before would undo. Competitions bring the
    # most text, so they come last, when no join moves the rows any more, unless they bring a key.
    rows = _attach(rows, read["entry_competitors"], ["entry_id"])
    names = ["player_event_metrics", "competitors"]
    names.insert(0 if "competitor_id" in read["competitions"].columns else 2, "competitions")
    for name in names:
        rows = _attach(rows, read[name], _JOIN_KEYS[name], null_safe and name != "competitions")
    if missing := [c for c, (name, _) in _READINGS.items() if name not in rows.columns]:
        raise ValueError(f"no source table has: {', '.join(missing)}")

    # The rows are read twice from here on: for the totals per competitor, and themselves.
    settled = settle(rows.withColumn("remaining", F.coalesce("remaining", F.lit(0.0))))
    rows = with_measures(settled)
    if repair_events := list(repair_events):
        rows = repair_ranks(rows, repair_events, "competition_id", one_task_rows)
    return S.conform(with_competitor_totals(rows, settled), S.RESULTS, keep_types=_IDS)


def _read(table: DataFrame) -> DataFrame:
    """Keys and known columns of a source table; anything else is dropped."""
    known = [
        reading(F.col(c)).alias(name)
        for c, (name, reading) in _READINGS.items()
        if c in table.columns
    ]
    return table.select(*[c for c in _KEYS if c in table.columns], *known)


def _owned(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table with its keys and the columns that no table before it has."""
    taken: set[str] = set()
    out = {}
    for name, table in tables.items():
        out[name] = table.select(*[c for c in table.columns if c in _JOIN_KEYS[name] or c not in taken])
        taken |= set(table.columns)
    return out


def _attach(rows, table, keys, null_safe=False):
    new = [c for c in table.columns if c in keys or c not in rows.columns]
    return lookup(rows, table.select(*new), keys, null_safe)


def with_measures(rows: DataFrame) -> DataFrame:
    """Add pace, penalty and corrected time."""
    pieces, remaining, seconds = F.col("pieces"), F.col("remaining"), F.col("seconds")
    return rows.withColumns(
        {
            "ppm": measures.ppm(pieces, remaining, seconds),
            "time_penalty": measures.time_penalty(pieces, remaining, seconds),
        }
    ).withColumn("corrected_time", measures.corrected_time(F.col("time_penalty"), seconds))


def with_competitor_totals(rows: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Add the number of rows and the latest known rating of each competitor.

    The latest rating is that of the last rated row by date; a row without a date counts
    as later than any date. An unknown competitor has neither. ``counted`` are the same rows
    before columns were added or changed that the totals do not need.
    """
    last = F.struct(F.col("date").isNull(), "date", "entry_id", "rating_out")
    rated = F.when(F.col("rating_out").isNotNull(), last)
    known = (rows if counted is None else counted).filter(F.col("competitor_id").isNotNull())
    totals = known.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.max_by("rating_out", rated).alias("latest_rating"),
    )
    return lookup_figures(rows, totals, ["competitor_id"])


def repair_ranks(
    rows: DataFrame,
    event_ids: Iterable[str],
    id_column: str = "event",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Replace the rank by the dense rank of the corrected time in the given events only."""
    broken = F.coalesce(F.col(id_column).isin(list(event_ids)), F.lit(False))
    ranked = with_rank(
        rows.filter(broken).drop("rank"),
        "rank",
        "corrected_time",
        [id_column],
        "dense",
        one_task_rows=one_task_rows,
    )
    repaired = ranked.withColumn("rank", F.col("rank").cast(rows.schema["rank"].dataType))
    return repaired.select(*rows.columns).unionByName(rows.filter(~broken))


# Sheet headers -> column names used here. Fixed values.
SHEET_HEADERS = {
    "Event": "event",
    "Name": "name",
    "Time": "time",
    "Remaining": "remaining",
    "Pieces": "pieces",
    "Date": "date",
    "Rank": "rank",
    "Event Name": "full_event",
    "Player Name": "name",
    "Player": "name",
    "12-Month Avg Completion Time": "avg_12m_text",
}
# Columns of a sheet that the fact is made from without holding them.
_SHEET_ONLY = frozenset(["source", "row_no", "time"])


def _named(frame: DataFrame, headers: dict[str, str], junk: Iterable[str]) -> DataFrame:
    """A sheet under the names of the fact; a column that has no place there is an error."""
    frame = drop_if_present(frame, *junk)
    known = {*S.RESULTS.fieldNames(), *_SHEET_ONLY}
    plain = {c: re.sub(r"\W+", "_", c.strip()).lower() for c in frame.columns}
    names = {c: headers.get(c, plain[c]) for c in frame.columns}
    if unknown := [c for c, name in names.items() if name not in known]:
        raise ValueError(f"no fact column for {', '.join(unknown)}: map it in headers or list it as junk")
    return frame.withColumnsRenamed(names)


def build_results_from_sheets(
    sheets: DataFrame,
    event_ratings: DataFrame,
    latest_ratings: DataFrame,
    junk: Iterable[str] = (),
    null_safe: bool = False,
    headers: dict[str, str] | None = None,
) -> DataFrame:
    """The result fact from event sheets.

    ``sheets`` has source, row_no, event (the title in each row), name, time, remaining and
    pieces, and may bring further fact columns. ``event_ratings`` is keyed by full_event and
    name, ``latest_ratings`` by name. Headers are read as fact columns in lower case with
    underscores ("Rating In" is rating_in); ``headers`` renames others, ``junk`` names those
    to leave out, and any other column is an error. Penalties assume the full size, whatever
    the size column says.
    """
    renames, junk = {**SHEET_HEADERS, **(headers or {})}, list(junk)
    sheets, event_ratings, latest_ratings = (
        _named(frame, renames, junk) for frame in (sheets, event_ratings, latest_ratings)
    )
    rows = tag_source(sheets)
    seconds = clock.parse_hms_strict(F.col("time"))
    remaining = measures.clean_remaining(F.col("remaining"))
    rows = rows.withColumns(
        {
            "time_text": F.col("time"),
            "seconds": seconds,
            "remaining": remaining,
            "time_penalty": measures.full_size_penalty(remaining, seconds),
            "name": measures.clean_name(F.col("name")),
            "pieces": measures.to_number(F.col("pieces")),
        }
    )
    corrected = measures.corrected_time(F.col("time_penalty"), F.col("seconds"))
    rows = rows.withColumn("corrected_time", corrected)
    if "date" in rows.columns:
        rows = rows.withColumn("date", clock.to_day(F.col("date")))
    rows = attach_ratings(rows, event_ratings, null_safe)
    rows = attach_latest(rows, latest_ratings, null_safe)
    return S.conform(rows, S.RESULTS, keep_types=_IDS)


def attach_ratings(rows: DataFrame, ratings: DataFrame, null_safe: bool = False) -> DataFrame:
    """Event ratings by (full_event, name)."""
    return _attach(rows, ratings, ["full_event", "name"], null_safe)


def attach_latest(rows: DataFrame, latest: DataFrame, null_safe: bool = False) -> DataFrame:
    """Latest ratings by name."""
    return _attach(rows, latest, ["name"], null_safe)
