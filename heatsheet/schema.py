"""Declared schemas: the result fact, the ranking and the source tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _REAL, _WHOLE = T.StringType(), T.DoubleType(), T.LongType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


RESULTS = _struct(
    entry_id=_TEXT,
    competitor_id=_TEXT,
    name=_TEXT,
    event=_TEXT,
    full_event=_TEXT,
    date=T.DateType(),
    time_text=_TEXT,
    seconds=_REAL,
    pieces=_REAL,
    remaining=_REAL,
    rank=T.IntegerType(),
    ppm=_REAL,
    time_penalty=_REAL,
    corrected_time=_REAL,
    rating_in=_REAL,
    rating_out=_REAL,
    event_strength=_REAL,
    latest_rating=_REAL,
    total_events=_WHOLE,
    avg_12m_text=_TEXT,
)

RANKINGS = _struct(
    name=_TEXT,
    eligible_attempts=_WHOLE,
    rating_rank=_WHOLE,
    z_rank=_WHOLE,
    percentile_rank=_WHOLE,
    avg_rank=_REAL,
    overall_rank=_WHOLE,
)

# Source tables of the refresh job. Only the columns the job reads or drops by
# name are declared; a real table may have more.
SOURCES = {
    "competition_entries": _struct(
        entry_id=_TEXT,
        competition_id=_TEXT,
        time_value=_TEXT,
        completion_time_seconds=_REAL,
        pieces_value=_TEXT,
        remaining_value=_TEXT,
        rank_in_competition=_WHOLE,
    ),
    "competitions": _struct(
        competition_id=_TEXT,
        competition_name=_TEXT,
        source_tab_name=_TEXT,
        competition_date=_TEXT,
        event_strength_rating=_REAL,
    ),
    "entry_competitors": _struct(entry_id=_TEXT, competitor_id=_TEXT),
    "competitors": _struct(competitor_id=_TEXT, display_name=_TEXT),
    "player_event_metrics": _struct(
        competitor_id=_TEXT,
        competition_id=_TEXT,
        rating_in=_REAL,
        rating_out=_REAL,
        rolling_12mo_avg_completion_time=_REAL,
    ),
}


def conform(df: DataFrame, schema: T.StructType, keep_types: tuple[str, ...] = ()) -> DataFrame:
    """Select the schema's columns in order, casting each; absent columns become NULL.

    Columns in ``keep_types`` keep the type they come with (ids may be numbers or text).
    """
    chosen = []
    for field in schema.fields:
        if field.name not in df.columns:
            value = F.lit(None).cast(field.dataType)
        elif field.name in keep_types:
            value = F.col(field.name)
        else:
            value = F.col(field.name).try_cast(field.dataType)
        chosen.append(value.alias(field.name))
    return df.select(*chosen)
