"""One event, or every event at once."""

from __future__ import annotations

from math import ceil, pi, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, measures
from ..operators.filters import for_event
from ..operators.joins import lookup, lookup_figures
from ..operators.ordering import by_size, quantiles, running_before, with_position
from ..settings import DENSITY_MAX_HOURS, DENSITY_POINTS, ONE_TASK_ROWS
from ..scratch import settle
from .profiles import population_pct


def _events(df: DataFrame, full_event: str | None) -> DataFrame:
    if full_event is None:
        return df.filter(F.col("full_event").isNotNull())
    return for_event(df, full_event)


def event_overview(
    df: DataFrame, full_event: str | None = None, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Entrants, fastest and mean time per event, each set against all events.

    ``entrants`` counts distinct names; ``entrants_with_unknown`` counts nameless rows as
    one more. ``fastest_pct`` is the share of all rows, untimed ones included, that are
    strictly faster than the event's best time.
    """
    pairs = _events(df, None).groupBy("full_event", "name").agg(
        F.min("seconds").alias("fastest"),
        F.sum(measures.micros(F.col("seconds"))).alias("__micros"),
        F.count("seconds").alias("__timed"),
    )
    events = pairs.groupBy("full_event").agg(
        F.count("name").alias("entrants"),
        F.count(F.lit(1)).alias("entrants_with_unknown"),
        F.min("fastest").alias("fastest"),
        F.try_divide(measures.exact_total(F.col("__micros")), F.sum("__timed")).alias("average"),
    )
    compared = population_pct(events, ["entrants", "average"], one_task_rows)

    times = settle(
        df.groupBy("seconds").agg(F.count(F.lit(1)).alias("n"))
    )
    rows = times.agg(F.sum("n")).first()[0] or 0
    faster = running_before(
        times.filter(F.col("seconds").isNotNull()),
        {"__faster": F.col("n")},
        [F.col("seconds").asc()],
        [],
        one_task_rows,
    ).select(F.col("seconds").alias("fastest"), "__faster")
    share = F.coalesce(F.col("__faster"), F.lit(0)) / F.lit(max(rows, 1)) * 100
    overview = lookup(compared, faster, ["fastest"]).select(
        "full_event",
        "entrants",
        "entrants_with_unknown",
        "entrants_pct",
        "fastest",
        share.alias("fastest_pct"),
        "average",
        "average_pct",
        clock.format_timedelta(F.col("fastest")).alias("fastest_text"),
        clock.format_timedelta(F.col("average")).alias("average_text"),
    )
    return overview if full_event is None else for_event(overview, full_event)


def performance_curve(
    df: DataFrame, full_event: str | None = None, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Attempts of an event from 1 (fastest) evenly down to 0; untimed ones come last."""
    rows = _events(df, full_event).select(
        "full_event", "entry_id", "name", "time_text", "date", "ppm", "rank", "seconds"
    )
    order = [F.col("seconds").asc_nulls_last(), F.col("entry_id")]
    key = ["full_event"]

    def small(part):
        event = Window.partitionBy(*key)
        return part.withColumns(
            {
                "__place": F.row_number().over(event.orderBy(*order)).cast("bigint"),
                "__rows": F.count(F.lit(1)).over(event),
            }
        )

    def large(part, sizes):
        placed = with_position(part, "__place", order, key, one_task_rows, sizes)
        counts = part.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows"))
        return lookup_figures(placed, counts, key)

    placed = by_size(rows, key, one_task_rows, None, small, large)
    step = F.try_divide((F.col("__place") - 1).cast("double"), F.col("__rows") - 1)
    return placed.select(
        *rows.columns,
        clock.hours(F.col("seconds")).alias("hours"),
        (1 - F.coalesce(step, F.lit(0.0))).alias("performance"),
    )


def leaderboard(
    df: DataFrame, full_event: str | None = None, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Attempts of an event by official rank, numbered from 1; unranked ones come last."""
    rows = _events(df, full_event).select(
        "full_event", "entry_id", "name", "time_text", "date", "ppm", "pieces", "rank"
    )
    order = [F.col("rank").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("entry_id")]
    placed = with_position(rows, "position", order, ["full_event"], one_task_rows).drop("rank")
    return placed if full_event is None else placed.orderBy("position")


def density(
    df: DataFrame,
    full_event: str | None = None,
    max_hours: float = DENSITY_MAX_HOURS,
    points: int = DENSITY_POINTS,
) -> DataFrame:
    """Gaussian kernel density of times, per event, beside that of all events.

    The bandwidth is the sample deviation times n^(-1/5). The event's curve is scaled to the
    peak of the overall curve. A side with fewer than two times, or without spread, has
    no curve.

    Times are summed into slices of an eighth of the bandwidth by their powers, from which
    the kernel sum of a slice follows to some 1e-11 of its height. So what meets the
    grid are slices, of which a spread of times holds few, and not rows; and a slice meets only
    the grid points that the kernel reaches.
    """
    timed = df.select("full_event", clock.hours(F.col("seconds")).alias("__x"))
    timed = timed.filter(F.col("__x") <= max_hours)
    per_event = _with_bandwidth(_events(timed, full_event), ["full_event"])
    curves = _curve(per_event, ["full_event"], max_hours, points)
    y_all = _curve(_with_bandwidth(timed, []), [], max_hours, points)
    y_all = settle(y_all.select("point", F.col("__y").alias("y_all")))

    # One row per grid point, so the broadcast and the windows are small.
    both = lookup(curves, F.broadcast(y_all), ["point"], how="inner")
    event = Window.partitionBy("full_event")
    peak, peak_all = F.max("__y").over(event), F.max("y_all").over(event)
    scaled = F.when(peak > 0, F.col("__y") * (peak_all / peak)).otherwise(F.col("__y"))
    return both.select("full_event", "point", "x", "y_all", scaled.alias("y_event"))


def _with_bandwidth(times: DataFrame, by: list[str]) -> DataFrame:
    """Add size ``__n`` and bandwidth ``__h`` to times ``__x``; drop sides without spread."""
    sides = times.groupBy(*by).agg(
        F.count("__x").alias("__n"),
        F.stddev_samp("__x").alias("__sd"),
        (F.min("__x") < F.max("__x")).alias("__spread"),
    )
    width = F.col("__sd") * F.pow(F.col("__n"), F.lit(-0.2))
    sides = sides.filter("__spread").select(*by, "__n", width.alias("__h"))
    if by:
        return lookup_figures(times, sides, by, how="inner")
    one = sides.first()
    if one is None:
        return times.limit(0).withColumns({"__n": F.lit(0), "__h": F.lit(0.0)})
    return times.withColumns({c: F.lit(one[c]) for c in sides.columns})


# Slices per bandwidth, powers kept of each, and the kernel's reach in bandwidths. At these,
# what is cut off is smaller than what doubles round.
_SLICES, _POWERS, _REACH = 8, 9, 9.0
# Pairs of a slice and a grid point that a task works on.
_TASK_PAIRS = 2_000_000


def _curve(times: DataFrame, by: list[str], max_hours: float, points: int) -> DataFrame:
    """Density on the grid of times ``__x`` with size ``__n`` and bandwidth ``__h``.

    With u the distance of a point and v that of a time from the middle of its slice, in
    bandwidths, exp(-(u - v)^2 / 2) is exp(-u^2 / 2) times the sum of He_k(u) v^k / k!, where
    He_k are the Hermite polynomials: He_0 = 1, He_1 = u, He_k+1 = u He_k - k He_k-1.
    """
    h, dx = F.col("__h"), max_hours / (points - 1)
    place = F.floor(F.col("__x") / h * _SLICES).alias("__slice")
    offset = F.col("__x") / h - (F.col("__slice") + 0.5) / _SLICES
    sliced = times.select(*by, "__n", "__h", "__x", place).withColumn("__v", offset)
    power, powers = F.lit(1.0), []
    for k in range(_POWERS):
        powers.append(F.sum(power).alias(f"__m{k}"))
        power = power * F.col("__v") / (k + 1)
    slices = settle(sliced.groupBy(*by, "__n", "__h", "__slice").agg(*powers))

    # Few bytes but much arithmetic follow, so the number of tasks goes by the work.
    tasks = max(1, ceil(slices.count() * points / _TASK_PAIRS))
    slices = slices.repartition(tasks, *by, "__slice")
    middle = (F.col("__slice") + 0.5) / _SLICES * h
    first = F.greatest(F.lit(0), F.ceil((middle - h * _REACH) / dx).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((middle + h * _REACH) / dx).cast("int"))
    reached = slices.withColumns({"__first": first, "__last": last}).filter("__first <= __last")
    on_grid = reached.withColumn("point", F.explode(F.sequence("__first", "__last")))
    on_grid = on_grid.withColumn("__u", (F.col("point") * F.lit(dx) - middle) / h)
    u, older, he = F.col("__u"), F.lit(0.0), F.lit(1.0)
    height = F.col("__m0")
    for k in range(1, _POWERS):
        name = f"__he{k}"
        on_grid = on_grid.withColumn(name, u * he - (k - 1) * older)
        older, he = he, F.col(name)
        height = height + he * F.col(f"__m{k}")
    sums = on_grid.groupBy(*by, "__n", "__h", "point").agg(F.sum(F.exp(u * u * -0.5) * height).alias("__sum"))

    # points that no kernel reaches have the height 0
    grid = slices.select(*by, "__n", "__h").distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    empty = grid.withColumn("__sum", F.lit(0.0))
    filled = sums.unionByName(empty).groupBy(*by, "__n", "__h", "point").agg(F.sum("__sum").alias("__sum"))
    y = F.col("__sum") / (F.col("__n") * F.col("__h") * F.lit(sqrt(2 * pi)))
    return filled.select(*by, "point", (F.col("point") * F.lit(dx)).alias("x"), y.alias("__y"))


def five_number(
    df: DataFrame, key: str, column: str, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Minimum, quartiles and maximum of a column per key: the figures of a box plot."""
    # ``quantiles`` reads its rows several times, and attempt numbers are costly to make
    known = settle(df.filter(F.col(key).isNotNull()).select(key, column))
    places = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return quantiles(known, column, places, [key], one_task_rows)


def with_attempt_number(df: DataFrame, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Add ``attempt_number``: the place of each row in its competitor's career."""
    order = [F.col("date").asc_nulls_last(), F.col("entry_id")]
    named = df.filter(F.col("name").isNotNull())
    return with_position(named, "attempt_number", order, ["name"], one_task_rows)
