"""Analytics of timed competitions on Spark DataFrames."""

from .operators.filters import (
    as_of_snapshot,
    distinct_keys,
    for_competitor,
    for_competitors,
    for_event,
    having_count,
    latest_date,
    split_bad_names,
    trailing,
    trailing_per_key,
)
from .operators.ordering import quantiles, row_mean, with_position, with_rank
from .operators.timeline import label_days, moving_average, spread_dates
from .plans.comparisons import (
    compare_bars,
    compare_history,
    compare_summary,
    ordered_attempts,
    rating_series,
)
from .plans.competitions import (
    density,
    event_overview,
    five_number,
    leaderboard,
    performance_curve,
    with_attempt_number,
)
from .plans.dashboard import (
    cumulative_competitors,
    cumulative_entries,
    cumulative_events,
    most_frequent,
    totals,
    totals_delta,
)
from .plans.medals import medal_long, top_medalists
from .plans.profiles import (
    competitor_profile,
    competitor_series,
    competitor_stats,
    event_detail,
    event_entries,
    history,
    medals,
    population_pct,
    with_entrants,
)
from .plans.ranking import (
    event_stats,
    min_eligible,
    rank_pair_bounds,
    rank_pairs,
    rankings,
    score_attempts,
)
from .plans.refresh import (
    attach_latest,
    attach_ratings,
    build_results,
    build_results_from_sheets,
    repair_ranks,
)
from .plans.timesearch import latest_state, time_search, time_search_counts
from .sources import (
    bucket_sources,
    current_path,
    discard,
    drop_if_present,
    list_tables,
    load_rankings,
    load_results,
    load_results_csv,
    load_tables,
    settle,
    tag_source,
    union_sources,
    write_rankings,
    write_results,
    write_results_csv,
)

__all__ = [name for name in dir() if not name.startswith("_")]
