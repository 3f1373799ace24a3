"""Measures of one attempt, cleaning of loose input, and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import FULL_PIECES

_MICROS = 1_000_000.0

# The shapes of a clock time and of a number in text.
_CLOCK_SHAPE = r"^\d{1,2}:\d{2}:\d{2}$"
_NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def ppm(pieces: Column, remaining: Column, seconds: Column) -> Column:
    """Pieces placed per minute; NULL when no time passed."""
    return F.try_divide(pieces - remaining, seconds.cast("double") / 60)


def time_penalty(pieces: Column, remaining: Column, seconds: Column) -> Column:
    """Time the remaining pieces would take at the same pace; NULL when none was placed."""
    return F.try_divide(remaining * seconds.cast("double"), pieces - remaining)


def corrected_time(penalty: Column, seconds: Column) -> Column:
    return penalty + seconds.cast("double")


def full_size_penalty(remaining: Column, seconds: Column) -> Column:
    return time_penalty(F.lit(FULL_PIECES), remaining, seconds)


def micros(seconds: Column) -> Column:
    """Whole microseconds, rounded: sums of them do not depend on the order of merging."""
    return F.round(seconds.cast("double") * _MICROS).try_cast("bigint")


def exact_sum(seconds: Column) -> Column:
    """Sum of times to the microsecond, the same however the rows are spread.

    Whole seconds and the rest are summed apart, so neither sum runs out of 64 bits.
    """
    seconds = seconds.cast("double")
    whole = F.floor(seconds)
    rest = F.round((seconds - whole) * _MICROS).cast("bigint")
    return F.sum(whole) + F.sum(rest) / F.lit(_MICROS)


def exact_mean(seconds: Column) -> Column:
    return F.try_divide(exact_sum(seconds), F.count(seconds))


def exact_total(sums: Column) -> Column:
    """Seconds of sums of ``micros``, summed further."""
    return F.sum(sums.cast("decimal(38,0)")).cast("double") / F.lit(_MICROS)


def to_number(value: Column) -> Column:
    """A number from text or a number; NULL for what cannot be read, NaN and infinities."""
    # a failing cast of text is slow, so its shape is tested first; for other types this folds away
    readable = (F.typeof(value) != "string") | value.cast("string").rlike(_NUMBER_SHAPE)
    number = F.when(readable, value.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)  # NaN counts as larger than infinity


def clean_remaining(value: Column) -> Column:
    """Remaining pieces: 0 when missing or when a clock time was entered by mistake."""
    text = value.cast("string")
    return F.when(value.isNull() | text.rlike(_CLOCK_SHAPE), F.lit(0.0)).otherwise(to_number(value))


def clean_name(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def zero_if_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint"))


def rank_of_total(rank: Column, total: Column) -> Column:
    """``N/T``; NULL without a rank."""
    entrants = zero_if_missing(total).cast("string")
    return F.concat(rank.cast("int").cast("string"), F.lit("/"), entrants)


def round_or_dash(value: Column, places: int = 2) -> Column:
    """Rounded half to even, as text; a dash when missing."""
    return F.coalesce(F.bround(value, places).cast("string"), F.lit("-"))


def medal(rank: Column, place: int) -> Column:
    """1 if the rank is this place, else 0."""
    return F.when(rank == place, F.lit(1)).otherwise(F.lit(0))

