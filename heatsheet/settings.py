"""Fixed values of the library."""

# A group of rows that is ordered inside one task may hold this many rows.
# Larger groups take the range-partitioned way in operators/ordering.py.
ONE_TASK_ROWS = 2_000_000

# Range partitions at most. Sorting and running sums spill, so a partition may outgrow
# ONE_TASK_ROWS; a shuffle with far more partitions than this would not pay.
MAX_RANGE_PARTS = 20_000

# A task costs more than the rows it brings when there are fewer of them than this, so range
# partitions beyond the first few hold as many.
RANGE_PART_ROWS = 100_000
FIRST_RANGE_PARTS = 32

# Fixed values of the analysis: they must stay as they are for right results.
FULL_PIECES = 500.0            # size class the analysis keeps
SERIES_DAYS = 547              # a competitor's series covers the last 1.5 years
AVERAGE_DAYS = 365             # width of the moving average
TOP_ROWS = 20                  # length of the "top" lists
SEARCH_MAX_SECONDS = 10_800    # upper end of the time search: three hours
DENSITY_MAX_HOURS = 5.0        # right end of the density grid
DENSITY_POINTS = 500           # points on the density grid
LABEL_LETTERS = 26             # repeated days are lettered (a) .. (z)

# Sums of doubles depend on the order in which partial sums merge. Averages are
# rounded to this many places before they are ranked, so that ties stay ties.
RANK_PLACES = 9
