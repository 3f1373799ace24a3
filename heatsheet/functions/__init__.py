from .clock import (
    day_label,
    format_hms,
    format_hms_hours,
    format_hms_or_dash,
    format_timedelta,
    hours,
    parse_hms_lenient,
    parse_hms_strict,
    to_day,
    unread_days,
)
from .measures import (
    clean_name,
    clean_remaining,
    corrected_time,
    exact_mean,
    exact_sum,
    exact_total,
    full_size_penalty,
    medal,
    micros,
    ppm,
    rank_of_total,
    round_or_dash,
    time_penalty,
    to_number,
    zero_if_missing,
)

__all__ = [
    "clean_name", "clean_remaining", "corrected_time", "day_label", "exact_mean", "exact_sum",
    "exact_total", "format_hms", "format_hms_hours", "format_hms_or_dash", "format_timedelta", "full_size_penalty", "hours",
    "medal", "micros", "parse_hms_lenient", "parse_hms_strict", "ppm", "rank_of_total", "round_or_dash",
    "time_penalty", "to_day", "to_number", "unread_days", "zero_if_missing",
]
