from ..scratch import discard, settle
from .files import current_path
from .sheets import drop_if_present, tag_source, union_sources
from .tables import (
    bucket_sources,
    list_tables,
    load_rankings,
    load_results,
    load_results_csv,
    load_tables,
    write_rankings,
    write_results,
    write_results_csv,
)

__all__ = [
    "bucket_sources", "current_path", "discard", "drop_if_present", "list_tables", "load_rankings", "load_results", "load_results_csv", "load_tables", "settle",
    "tag_source", "union_sources", "write_rankings", "write_results", "write_results_csv",
]
