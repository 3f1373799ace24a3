"""Clock times: reading and writing them as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_PART = r"\s*[+-]?\d+\s*"
_THREE_PARTS = f"^{_PART}:{_PART}:{_PART}$"
_TWO_PARTS = f"^{_PART}:{_PART}$"

# The months as dates in text name them.
_MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
# What stands between the parts of a date, as in 8/11/2025, Aug 11, 2025 or 11.08.2025.
_BETWEEN = r"[/.\-\s,]+"

# The shape is tested first, because a failing cast of text is slow. Parts are cut with
# substring_index, which needs neither a regular expression nor an array.


def _number(text: Column) -> Column:
    return text.try_cast("bigint")


def _sixty_times(units: Column, more: Column) -> Column:
    return F.try_add(F.try_multiply(units, F.lit(60)), more)


def _seconds_of_three(text: Column) -> Column:
    first = _number(F.substring_index(text, ":", 1))
    second = _number(F.substring_index(F.substring_index(text, ":", 2), ":", -1))
    last = _number(F.substring_index(text, ":", -1))
    return F.when(text.rlike(_THREE_PARTS), _sixty_times(_sixty_times(first, second), last))


def _seconds_of_two(text: Column) -> Column:
    first = _number(F.substring_index(text, ":", 1))
    last = _number(F.substring_index(text, ":", -1))
    return F.when(text.rlike(_TWO_PARTS), _sixty_times(first, last))


def parse_hms_strict(text: Column) -> Column:
    """Seconds of ``H:MM:SS``; NULL unless there are exactly three whole numbers."""
    return _seconds_of_three(text)


def parse_hms_lenient(text: Column) -> Column:
    """Seconds of ``H:MM:SS`` or ``MM:SS``; 0 for anything else, missing text included."""
    zero = F.lit(0).cast("bigint")
    return F.coalesce(_seconds_of_three(text), _seconds_of_two(text), zero)


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _minutes_seconds(whole: Column) -> list[Column]:
    minutes = F.floor(F.pmod(whole, F.lit(3600)) / 60)
    return [F.lit(":"), _two_digits(minutes), F.lit(":"), _two_digits(F.pmod(whole, F.lit(60)))]


def format_hms(seconds: Column) -> Column:
    """``HH:MM:SS``, fractions cut off, hours beyond 99 written in full; NULL stays NULL."""
    whole = seconds.cast("bigint")
    hours = F.floor(whole / 3600).cast("string")
    padded = F.lpad(hours, F.greatest(F.length(hours), F.lit(2)), F.lit("0"))
    return F.concat(padded, *_minutes_seconds(whole))


def format_hms_hours(hours: Column) -> Column:
    """``HH:MM:SS`` of a time in hours."""
    return format_hms(F.floor(hours * 3600))


def format_hms_or_dash(seconds: Column) -> Column:
    return F.coalesce(format_hms(seconds), F.lit("-"))


def format_timedelta(seconds: Column) -> Column:
    """``[D day[s], ]H:MM:SS``, fractions cut off; NULL stays NULL."""
    whole = seconds.cast("bigint")
    days = F.floor(whole / 86_400)
    unit = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    prefix = F.when(days == 0, F.lit("")).otherwise(F.concat(days.cast("string"), unit))
    hours = F.floor(F.pmod(whole, F.lit(86_400)) / 3600).cast("string")
    return F.concat(prefix, hours, *_minutes_seconds(whole))


def hours(seconds: Column) -> Column:
    return seconds / F.lit(3600.0)


def to_day(value: Column) -> Column:
    """A date from a date, a timestamp or text; NULL for what cannot be read.

    Text is ISO, with or without a time, or has three parts in one of these orders: year,
    month, day if the first part has four digits; month by name and day on either side of each
    other; day, month with dots (11.08.2025); else month, day (8/11/2025). The year has four
    digits, a month's name three letters or more.
    """
    typed = F.typeof(value).isin("date", "timestamp", "timestamp_ntz")  # folds away
    return F.when(typed, value.try_cast("date")).otherwise(_day_of_text(F.btrim(value.cast("string"))))


def _day_of_text(text: Column) -> Column:
    iso = F.substring(text, 5, 1) == "-"
    dotted = r"^(\d{1,2})\.(\d{1,2})\."
    text = F.when(F.substring(text, -5, 1) == ".", F.regexp_replace(text, dotted, "$2.$1.")).otherwise(text)
    # a cast reads a day and leaves out what follows, so more than a day is read as a time
    day_or_time = F.when(F.length(text) <= 10, text.try_cast("date")).otherwise(text.try_cast("timestamp").cast("date"))
    # a lambda has the parts made once for all the places that use them
    other = F.get(F.transform(F.array(F.split(text, _BETWEEN)), _iso_of_parts), F.lit(0)).try_cast("date")
    return F.when(iso, day_or_time).otherwise(other)


def _iso_of_parts(parts: Column) -> Column:
    """Year, month and day as ISO text; what the parts are made of tells their order."""
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))

    def joined(*ordered: Column) -> Column:
        return F.concat(ordered[0], F.lit("-"), ordered[1], F.lit("-"), ordered[2])

    return (
        F.when(F.size(parts) != 3, None)
        .when(first >= "A", joined(third, _month(first), second))
        .when(second >= "A", joined(third, _month(second), first))
        .when(F.length(first) == 4, joined(first, second, third))
        .otherwise(joined(third, first, second))
    )


def _month(name: Column) -> Column:
    """Number of a month by its name or the first letters of it; text, NULL if it is none."""
    lower = F.lower(name)
    number = F.floor((F.instr(F.lit("".join(m[:3] for m in _MONTHS)), F.substring(lower, 1, 3)) + 2) / 3)
    full = F.get(F.array(*map(F.lit, _MONTHS)), number.cast("int") - 1)
    return F.when((F.length(lower) >= 3) & F.startswith(full, lower), number.cast("string"))


def unread_days(df: DataFrame, column: str) -> DataFrame:
    """The texts of a column that ``to_day`` cannot read, with their number of rows."""
    text = F.btrim(F.col(column).cast("string"))
    unread = df.filter((text != "") & to_day(F.col(column)).isNull())
    return unread.groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("rows"))


def day_label(day: Column) -> Column:
    """``Mon DD, YYYY``"""
    return F.date_format(day, "MMM dd, yyyy")
