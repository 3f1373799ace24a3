"""The same queries in plain SQL, written for an independent engine."""

from __future__ import annotations

from .binding import UNRANKED_EVENT


def hms(x: str) -> str:
    """HH:MM:SS of a SQL expression in seconds, fractions cut off."""
    s = f"CAST(floor({x}) AS BIGINT)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60)"


def span(x: str) -> str:
    """[D day[s], ]H:MM:SS of a SQL expression in seconds."""
    s = f"CAST(floor({x}) AS BIGINT)"
    days = f"({s} // 86400)"
    clock = f"printf('%d:%02d:%02d', ({s} % 86400) // 3600, ({s} % 3600) // 60, {s} % 60)"
    prefix = (
        f"CASE WHEN {days} = 0 THEN '' WHEN {days} = 1 THEN '1 day, ' "
        f"ELSE concat({days}, ' days, ') END"
    )
    return f"CASE WHEN {x} IS NOT NULL THEN concat({prefix}, {clock}) END"


def clock(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {hms(x)} END"


ATTEMPTS = """
base AS (
  SELECT o_orderkey AS entry_id,
         o_custkey AS competitor_id,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              WHEN o_custkey % 50 = 1
                THEN concat('Customer#', lpad(CAST(o_custkey - 1 AS VARCHAR), 9, '0'))
              ELSE c_name END AS name,
         concat(substr(CAST(o_orderdate AS VARCHAR), 1, 7), '|', o_orderpriority) AS event,
         concat('Open ', substr(CAST(o_orderdate AS VARCHAR), 1, 7), ' ', o_orderpriority)
           AS full_event,
         CASE WHEN o_orderkey % 211 = 0 THEN NULL
              ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS date,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL
              WHEN o_orderkey % 10 = 9 THEN CAST(1000 AS DOUBLE)
              ELSE CAST(500 AS DOUBLE) END AS pieces,
         CASE WHEN o_orderkey % 53 = 0 THEN NULL
              ELSE floor(o_totalprice / 25 * 2) / 2 END AS seconds,
         CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey % 120 AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS remaining,
         CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_totalprice / 100000 END AS rating_out
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

FACT = f"""{ATTEMPTS}, measured AS (
  SELECT *,
         CASE WHEN seconds > 0 THEN (pieces - remaining) / (CAST(seconds AS DOUBLE) / 60) END AS ppm,
         CASE WHEN pieces <> remaining
              THEN remaining * CAST(seconds AS DOUBLE) / (pieces - remaining) END AS time_penalty
  FROM base
), corrected AS (
  SELECT *, time_penalty + CAST(seconds AS DOUBLE) AS corrected_time FROM measured
), last_rating AS (
  SELECT competitor_id, rating_out AS latest_rating FROM (
    SELECT *, row_number() OVER (PARTITION BY competitor_id
              ORDER BY (date IS NULL) DESC, date DESC, entry_id DESC) AS nth
    FROM corrected WHERE rating_out IS NOT NULL) WHERE nth = 1
), paced AS (
  SELECT *, avg(seconds) OVER (PARTITION BY competitor_id ORDER BY date
              RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW) AS pace
  FROM corrected
), fact AS (
  SELECT entry_id, competitor_id, name, event, full_event, date,
         {clock('seconds')} AS time_text,
         seconds, pieces, remaining,
         CASE WHEN corrected_time IS NOT NULL AND event <> '{UNRANKED_EVENT}' THEN CAST(
           dense_rank() OVER (PARTITION BY event ORDER BY corrected_time ASC NULLS LAST)
           AS INT) END AS rank,
         ppm, time_penalty, corrected_time,
         CAST(NULL AS DOUBLE) AS rating_in, rating_out, CAST(NULL AS DOUBLE) AS event_strength,
         latest_rating,
         count(*) OVER (PARTITION BY competitor_id) AS total_events,
         CASE WHEN date IS NOT NULL AND pace IS NOT NULL THEN {hms('pace')} END AS avg_12m_text
  FROM paced LEFT JOIN last_rating USING (competitor_id)
), r AS (
  SELECT * FROM fact WHERE pieces = 500 OR pieces IS NULL
), good AS (
  SELECT * FROM r WHERE name IS NOT NULL
), entries AS (
  SELECT full_event, count(name) AS entries FROM r GROUP BY full_event
)"""

# Average-tie rank over the number of known values, times 100.
def pct(x: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    ties = f"PARTITION BY {by}, {x}" if by else f"PARTITION BY {x}"
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {x} ASC NULLS LAST)"
        f" + (count(*) OVER ({ties}) - 1) / 2.0) / count({x}) OVER ({part}) * 100 END"
    )


SCORES = f"""ev AS (
  SELECT event, count(*) AS attempts, count(x) AS timed, avg(x) AS mean, stddev_samp(x) AS sd
  FROM scored_rows WHERE event IS NOT NULL GROUP BY event HAVING count(*) >= 10
), sc AS (
  SELECT s.*, ev.timed,
         -(x - mean) / CASE WHEN timed = 1 OR sd = 0 OR sd IS NULL THEN 1 ELSE sd END AS z,
         {pct('x', 's.event')} AS pct
  FROM scored_rows s JOIN ev ON s.event = ev.event
)"""


def ranking(weighted: bool = False) -> str:
    columns = ["rating_rank", "z_rank", "percentile_rank"]
    weighted_ranks = ""
    if weighted:
        columns += ["weighted_z_rank", "weighted_percentile_rank"]
        weighted_ranks = """,
         CASE WHEN wz IS NOT NULL THEN rank() OVER (ORDER BY wz DESC NULLS LAST) END
           AS weighted_z_rank,
         CASE WHEN wp IS NOT NULL THEN rank() OVER (ORDER BY wp ASC NULLS LAST) END
           AS weighted_percentile_rank"""
    total = " + ".join(f"coalesce({c}, 0)" for c in columns)
    known = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in columns)
    listed = ", ".join(columns)
    return f"""scored_rows AS (
  SELECT event, name, date, corrected_time AS x FROM r
  WHERE date >= (SELECT max(date) FROM r) - INTERVAL 1 YEAR
), {SCORES}, people AS (
  SELECT name, count(*) AS attempts, round(avg(z), 9) AS mz, round(avg(pct), 9) AS mp,
         round(coalesce(sum(z * timed), 0) / nullif(sum(timed), 0), 9) AS wz,
         round(coalesce(sum(pct * timed), 0) / nullif(sum(timed), 0), 9) AS wp
  FROM sc WHERE name IS NOT NULL GROUP BY name HAVING count(*) >= 3
), placed AS (
  SELECT *,
         row_number() OVER (ORDER BY mz DESC NULLS LAST, name) AS z_rank,
         CASE WHEN mp IS NOT NULL THEN rank() OVER (ORDER BY mp ASC NULLS LAST) END
           AS percentile_rank{weighted_ranks}
  FROM people
), pairs AS (
  SELECT DISTINCT name, total_events, latest_rating FROM r
), joined AS (
  SELECT placed.*, total_events, latest_rating,
         row_number() OVER (ORDER BY latest_rating ASC NULLS LAST, placed.name, total_events)
           AS rating_rank
  FROM placed LEFT JOIN pairs ON placed.name = pairs.name
), averaged AS (
  SELECT *, ({total}) / CAST(({known}) AS DOUBLE) AS avg_rank FROM joined
), ranking AS (
  SELECT name, attempts AS eligible_attempts, {listed}, avg_rank,
         row_number() OVER (ORDER BY avg_rank, name, rating_rank) AS overall_rank
  FROM averaged
)"""


_RANKING_COLUMNS = """name, CAST(eligible_attempts AS BIGINT) AS eligible_attempts, rating_rank,
  z_rank, percentile_rank, {extra} round(avg_rank, 6) AS avg_rank, overall_rank"""

HISTORY = """name, entry_id, date, r.full_event,
  CASE WHEN rank IS NOT NULL THEN concat(rank, '/', coalesce(entries, 0)) END AS rank_text,
  time_text, round(ppm, 6) AS ppm, pieces, remaining, event_strength,
  rating_out, avg_12m_text
  FROM {rows} r LEFT JOIN entries ON r.full_event = entries.full_event"""

SUMMARY = f"""newest AS (
  SELECT max(date) AS latest FROM good
), means AS (
  SELECT name, count(*) AS events, avg(seconds) AS avg_seconds, avg(ppm) AS avg_ppm,
         count(*) FILTER (date >= latest - INTERVAL 1 YEAR) AS last_year_events,
         avg(seconds) FILTER (date >= latest - INTERVAL 1 YEAR) AS last_year_seconds,
         avg(ppm) FILTER (date >= latest - INTERVAL 1 YEAR) AS last_year_ppm
  FROM good, newest GROUP BY name
), summary AS (
  SELECT means.name, overall_rank AS rank, CAST(events AS BIGINT) AS events,
         {clock('avg_seconds')} AS average_time,
         coalesce(CAST(round_even(avg_ppm, 2) AS VARCHAR), '-') AS average_ppm,
         CAST(last_year_events AS BIGINT) AS last_year_events,
         coalesce({clock('last_year_seconds')}, '-') AS last_year_time,
         coalesce(CAST(round_even(last_year_ppm, 2) AS VARCHAR), '-') AS last_year_average_ppm,
         round(avg_seconds, 6) AS avg_seconds, round(avg_ppm, 6) AS avg_ppm,
         round(last_year_seconds, 6) AS last_year_seconds,
         round(last_year_ppm, 6) AS last_year_ppm,
         round(last_year_seconds / 3600, 6) AS last_year_hours
  FROM means LEFT JOIN ranking ON means.name = ranking.name
)"""

LABEL = """strftime(date, '%b %d, %Y')"""
_NTH = "row_number() OVER (PARTITION BY name, date ORDER BY entry_id)"
LETTERED = (
    f"concat({LABEL}, CASE WHEN {_NTH} = 1 THEN '' "
    f"WHEN {_NTH} <= 27 THEN concat(' (', chr(CAST(95 + {_NTH} AS INT)), ')') "
    f"ELSE concat(' (', {_NTH} - 1, ')') END)"
)

STATE = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY date DESC NULLS LAST, entry_id) AS nth
  FROM good
), state AS (
  SELECT name, max(date) AS date,
         arg_min(full_event, nth) FILTER (full_event IS NOT NULL) AS full_event,
         arg_min(total_events, nth) FILTER (total_events IS NOT NULL) AS total_events,
         arg_min(avg_12m_text, nth) FILTER (avg_12m_text IS NOT NULL) AS avg_12m_text
  FROM ordered GROUP BY name
), paces AS (
  SELECT *, coalesce(CAST(split_part(avg_12m_text, ':', 1) AS BIGINT) * 3600
                   + CAST(split_part(avg_12m_text, ':', 2) AS BIGINT) * 60
                   + CAST(split_part(avg_12m_text, ':', 3) AS BIGINT), 0) AS pace_seconds
  FROM state
)"""


def _moving(value: str, rows: str) -> str:
    """Mean of the last 365 days, of the own day only rows up to the own one."""
    return f"""SELECT a.entry_id, a.name, a.date, avg(b.{value}) AS moving
  FROM {rows} a JOIN {rows} b ON a.name = b.name AND b.date > a.date - INTERVAL 365 DAY
   AND (b.date < a.date OR (b.date = a.date AND b.entry_id <= a.entry_id))
  GROUP BY ALL"""


_SPREAD = """SELECT entry_id, name, date, CAST(DATE '1970-01-01' + CAST(nth + max(day - nth)
    OVER (PARTITION BY name ORDER BY nth) AS INT) AS DATE) AS spread_date
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', date) AS day,
               row_number() OVER (PARTITION BY name ORDER BY date, entry_id) AS nth
        FROM {rows})"""


def _first_dates(key: str, out: str) -> str:
    return f"""SELECT date, CAST(sum(count(*)) OVER (ORDER BY date) AS BIGINT) AS {out}
    FROM (SELECT {key}, min(date) AS date FROM r WHERE date IS NOT NULL GROUP BY {key})
    GROUP BY date"""



STAR = f"""WITH entries AS (
  SELECT o_orderkey AS entry_id, strftime(o_orderdate, '%Y-%m') AS competition_id,
         {hms('o_totalprice / 25')} AS time_text,
         CASE WHEN o_orderkey % 53 <> 0 THEN floor(o_totalprice / 25 * 2) / 2 END AS seconds,
         CAST(500 AS DOUBLE) AS pieces,
         CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey % 120 AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS remaining,
         CAST(o_orderkey % 50 AS INT) AS rank
  FROM orders
), competitions AS (
  SELECT concat(CASE WHEN month(o_orderdate) = 2 THEN '-' END, strftime(o_orderdate, '%Y-%m')) AS competition_id,
         concat('Open ', strftime(max(o_orderdate), '%Y-%m')) AS full_event,
         strftime(max(o_orderdate), '%Y-%m') AS event,
         CAST(concat(strftime(max(o_orderdate), '%Y-%m'), '-15') AS DATE) AS date,
         round(avg(o_totalprice) / 100000, 4) AS event_strength
  FROM orders GROUP BY 1
), bridge AS (
  SELECT DISTINCT CASE WHEN l_orderkey % 19 = 0 THEN -l_orderkey ELSE l_orderkey END AS entry_id,
         l_suppkey * 7 + l_linenumber AS competitor_id
  FROM lineitem
), competitors AS (
  SELECT CASE WHEN c_custkey % 13 = 0 THEN -c_custkey ELSE c_custkey END AS competitor_id,
         c_name AS name FROM customer
), metrics AS (
  SELECT CASE WHEN (l_suppkey * 7 + l_linenumber) % 11 = 0 THEN -(l_suppkey * 7 + l_linenumber)
              ELSE l_suppkey * 7 + l_linenumber END AS competitor_id,
         strftime(o_orderdate, '%Y-%m') AS competition_id,
         max(l_quantity) AS rating_in, min(l_quantity) AS rating_out,
         max(l_extendedprice) AS pace
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2
), joined AS (
  SELECT e.entry_id, b.competitor_id, e.competition_id, name, event, full_event, date, time_text,
         seconds, pieces, remaining, rank, rating_in, rating_out, event_strength, pace,
         CASE WHEN seconds > 0 THEN (pieces - remaining) / (CAST(seconds AS DOUBLE) / 60) END AS ppm,
         CASE WHEN pieces <> remaining
              THEN remaining * CAST(seconds AS DOUBLE) / (pieces - remaining) END AS time_penalty
  FROM entries e
  LEFT JOIN competitions USING (competition_id)
  LEFT JOIN bridge b ON e.entry_id = b.entry_id
  LEFT JOIN competitors k ON b.competitor_id = k.competitor_id
  LEFT JOIN metrics m ON b.competitor_id = m.competitor_id AND e.competition_id = m.competition_id
), corrected AS (
  SELECT *, time_penalty + CAST(seconds AS DOUBLE) AS corrected_time FROM joined
), last_rating AS (
  SELECT competitor_id, rating_out AS latest_rating FROM (
    SELECT *, row_number() OVER (PARTITION BY competitor_id
       ORDER BY (date IS NULL) DESC, date DESC, entry_id DESC) AS nth
    FROM corrected WHERE rating_out IS NOT NULL AND competitor_id IS NOT NULL) WHERE nth = 1
)
SELECT entry_id, corrected.competitor_id, name, event, full_event, date, time_text, seconds, pieces,
       remaining,
       CASE WHEN competition_id IN ('1997-03', '1998-05')
            THEN CASE WHEN corrected_time IS NOT NULL THEN CAST(dense_rank() OVER (
                   PARTITION BY competition_id ORDER BY corrected_time ASC NULLS LAST) AS INT) END
            ELSE rank END AS rank,
       round(ppm, 6) AS ppm, round(time_penalty, 6) AS time_penalty,
       round(corrected_time, 6) AS corrected_time, round(rating_in, 6) AS rating_in,
       rating_out, round(event_strength, 6) AS event_strength,
       latest_rating,
       CASE WHEN corrected.competitor_id IS NOT NULL
            THEN CAST(count(*) OVER (PARTITION BY corrected.competitor_id) AS BIGINT) END
         AS total_events,
       {clock('pace')} AS avg_12m_text
FROM corrected LEFT JOIN last_rating ON corrected.competitor_id = last_rating.competitor_id"""

SHEETS = f"""WITH {ATTEMPTS}, titles AS (
  SELECT event, concat('Title ', min(entry_id), ' of ',
         arg_min(full_event, entry_id)) AS full_event
  FROM base GROUP BY event
), cells AS (
  SELECT b.entry_id, b.name, b.event, t.full_event, seconds AS s, remaining AS rem,
         CASE WHEN b.entry_id % 31 = 0 THEN substr({clock('seconds')}, 4, 5)
              WHEN b.entry_id % 37 = 0 THEN 'DNF' ELSE {clock('seconds')} END AS time_text,
         CASE WHEN b.entry_id % 31 = 0 OR b.entry_id % 37 = 0 THEN NULL ELSE floor(seconds) END AS seconds,
         CASE WHEN b.entry_id % 43 = 0 THEN NULL ELSE pieces END AS pieces,
         CASE WHEN b.entry_id % 47 <> 0 THEN b.date END AS date, CAST(b.entry_id % 50 AS INT) AS rank, CAST(b.entry_id % 7 + 0.5 AS DOUBLE) AS ppm,
         CAST(b.entry_id % 10 AS DOUBLE) AS rating_in, CAST(b.entry_id % 9 AS DOUBLE) AS event_strength,
         {clock('seconds')} AS avg_12m_text,
         CASE WHEN b.entry_id % 29 = 0 THEN 0 WHEN b.entry_id % 31 = 0 THEN 0 ELSE remaining END
           AS remaining
  FROM base b JOIN titles t ON b.event = t.event
), penalties AS (
  SELECT *, remaining * CAST(seconds AS DOUBLE) / (500 - remaining) AS time_penalty FROM cells
), event_ratings AS (
  SELECT event, name, max(rating_out) AS rating_out FROM base WHERE name IS NOT NULL
  GROUP BY event, name
), latest AS (
  SELECT name, min(rating_out) AS latest_rating, count(*) AS total_events FROM base
  WHERE name IS NOT NULL GROUP BY name
)
SELECT entry_id, p.name, p.event, p.full_event, time_text, seconds, pieces,
       CAST(remaining AS DOUBLE) AS remaining, round(time_penalty, 6) AS time_penalty,
       round(time_penalty + seconds, 6) AS corrected_time, rating_out,
       latest_rating, CAST(total_events AS BIGINT) AS total_events, date, rank, ppm, rating_in,
       event_strength, avg_12m_text
FROM penalties p
LEFT JOIN event_ratings e ON p.event = e.event AND p.name = e.name
LEFT JOIN latest l ON p.name = l.name"""

CLOCK_TEXTS = f"""WITH texts AS (
  SELECT *, CAST(floor(l_extendedprice * 3) AS BIGINT) AS spent,
         CASE l_linenumber WHEN 1 THEN {hms('floor(l_extendedprice * 3)')}
              WHEN 2 THEN concat(l_partkey, ':07') WHEN 3 THEN 'no time' WHEN 4 THEN NULL
              ELSE '1:2:x' END AS time_text
  FROM lineitem
)
SELECT l_orderkey, l_linenumber, time_text,
       CASE WHEN l_linenumber = 1 THEN spent END AS strict_seconds,
       CASE WHEN l_linenumber = 1 THEN spent WHEN l_linenumber = 2 THEN l_partkey * 60 + 7 ELSE 0 END
         AS lenient_seconds,
       CASE WHEN l_linenumber = 1 THEN time_text ELSE '-' END AS dashed,
       {span('spent')} AS span,
       {hms('CAST(l_partkey AS DOUBLE) / 3600 * 3600')} AS hours_text,
       strftime(l_shipdate, '%b %d, %Y') AS day_label,
       CAST(l_shipdate AS DATE) AS day,
       CASE WHEN l_linenumber = 4 OR (l_linenumber = 1 AND spent < 360000)
            THEN CAST(0 AS DOUBLE) END AS remaining,
       l_returnflag AS flag,
       CASE WHEN l_linenumber = 4 THEN '-'
            ELSE CAST(round_even(l_discount / 8, 2) AS VARCHAR) END AS shown_ratio,
       CASE WHEN l_linenumber <> 5 THEN concat(l_linenumber, '/', l_suppkey) END AS place
FROM texts"""

DENSITY = """t AS (
  SELECT full_event, seconds, CAST(seconds AS DOUBLE) / 3600 AS x FROM r
  WHERE CAST(seconds AS DOUBLE) / 3600 <= 5
), grid AS (
  SELECT range AS point, range * (CAST(5 AS DOUBLE) / 499) AS gx FROM range(500)
), a AS (
  SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM t
), aw AS (
  SELECT x, count(*) AS w FROM t GROUP BY x
), ya AS (
  SELECT point, sum(w * exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (any_value(n) * any_value(h)
         * sqrt(2 * pi())) AS y
  FROM grid, aw, a GROUP BY point
), e AS (
  SELECT full_event, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM t
  GROUP BY full_event HAVING count(*) >= 2 AND stddev_samp(x) > 0
), ye AS (
  SELECT t.full_event, point, any_value(gx) AS gx,
         sum(exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (any_value(n) * any_value(h)
         * sqrt(2 * pi())) AS y
  FROM t JOIN e ON t.full_event = e.full_event, grid GROUP BY t.full_event, point
)
SELECT full_event, CAST(ye.point AS INT) AS point, round(gx, 6) AS x, round(ya.y, 6) AS y_all,
       round(CASE WHEN max(ye.y) OVER (PARTITION BY full_event) > 0
             THEN ye.y * (max(ya.y) OVER (PARTITION BY full_event)
                          / max(ye.y) OVER (PARTITION BY full_event)) ELSE ye.y END, 6) AS y_event
FROM ye JOIN ya ON ye.point = ya.point"""


def oracle_sql() -> dict[str, str]:
    ranked = f"WITH {FACT}, {ranking()}"
    figures = """count(DISTINCT full_event) AS events, coalesce(sum(pieces), 0) AS pieces,
      min(seconds) AS fastest, avg(seconds) AS average"""
    sql = {
        "result_fact": f"""WITH {FACT} SELECT entry_id, competitor_id, name, event, full_event, date,
            time_text, seconds, pieces, remaining, rank, round(ppm, 6) AS ppm,
            round(time_penalty, 6) AS time_penalty, round(corrected_time, 6) AS corrected_time,
            rating_in, rating_out, event_strength,
            latest_rating, CAST(total_events AS BIGINT) AS total_events,
            avg_12m_text FROM fact""",
        "build_results": STAR,
        "build_results_from_sheets": SHEETS,
        "size_class": f"WITH {FACT} SELECT entry_id, pieces FROM r",
        "repair_ranks": f"""WITH {FACT} SELECT entry_id, event,
            CASE WHEN event IN ('{UNRANKED_EVENT}', '1996-06|5-LOW')
                 THEN CASE WHEN corrected_time IS NOT NULL THEN CAST(dense_rank() OVER (
                   PARTITION BY event ORDER BY corrected_time ASC NULLS LAST) AS INT) END
                 ELSE rank END AS rank FROM fact""",
        "clock_texts": CLOCK_TEXTS,
        "rankings": f"{ranked} SELECT {_RANKING_COLUMNS.format(extra='')} FROM ranking",
        "rankings_weighted": f"WITH {FACT}, {ranking(True)} SELECT "
        + _RANKING_COLUMNS.format(extra="weighted_z_rank, weighted_percentile_rank,")
        + " FROM ranking",
        "event_stats": f"""WITH {FACT}, s AS (
            SELECT event, avg(corrected_time) AS mean, stddev_samp(corrected_time) AS sd,
                   count(corrected_time) AS timed, quantile_cont(corrected_time, 0.5) AS median,
                   quantile_cont(corrected_time, 0.75) - quantile_cont(corrected_time, 0.25) AS iqr
            FROM r WHERE event IS NOT NULL GROUP BY event)
            SELECT event, round(mean, 6) AS mean, round(sd, 6) AS sd, timed,
                   round(median, 6) AS median, round(iqr, 6) AS iqr,
                   round(CASE WHEN timed = 1 OR sd = 0 OR sd IS NULL THEN 1 ELSE sd END, 6) AS sd_used,
                   round(CASE WHEN iqr = 0 OR iqr IS NULL THEN 1 ELSE iqr END, 6) AS iqr_used
            FROM s""",
        "score_attempts": f"""WITH {FACT}, scored_rows AS (
            SELECT entry_id, event, corrected_time AS x FROM r), {SCORES}
            SELECT entry_id, event, timed AS event_timed, round(z, 6) AS z,
                   round(pct, 6) AS percentile FROM sc""",
        "min_eligible": f"{ranked} SELECT min(eligible_attempts) AS min_eligible FROM ranking",
    }
    columns = ["rating_rank", "z_rank", "percentile_rank", "avg_rank"]
    pairs = " UNION ALL ".join(
        f"SELECT '{x}' AS x_col, '{y}' AS y_col, name, CAST({x} AS DOUBLE) AS x, "
        f"CAST({y} AS DOUBLE) AS y FROM ranking WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        for i, x in enumerate(columns)
        for y in columns[i + 1:]
    )
    sql["rank_pairs"] = f"""{ranked} SELECT x_col, y_col, name, round(x, 6) AS x, round(y, 6) AS y
        FROM ({pairs})"""
    sql["rank_pair_bounds"] = f"""{ranked} SELECT x_col, y_col,
        round(greatest(min(x), min(y)), 6) AS low, round(least(max(x), max(y)), 6) AS high
        FROM ({pairs}) GROUP BY x_col, y_col"""

    medal_counts = ", ".join(
        f"count(*) FILTER (rank = {k}) AS {c}"
        for c, k in (("gold", 1), ("silver", 2), ("bronze", 3))
    )
    sql |= {
        "medals": f"""WITH {FACT} SELECT name, {medal_counts} FROM good WHERE date IS NOT NULL
            GROUP BY name""",
        "competitor_stats": f"""WITH {FACT}, s AS (SELECT name, {figures} FROM good
            WHERE date IS NOT NULL GROUP BY name)
            SELECT name, events, pieces, fastest, round(average, 6) AS average FROM s""",
        "population_pct": f"""WITH {FACT}, p AS (SELECT name, count(DISTINCT full_event) AS events,
            min(seconds) AS fastest FROM good GROUP BY name)
            SELECT name, events, fastest, round({pct('events')}, 6) AS events_pct,
                   round({pct('fastest')}, 6) AS fastest_pct FROM p""",
        "competitor_profile": f"""{ranked}, p AS (SELECT name, {figures} FROM good GROUP BY name),
            q AS (SELECT name, {pct('events')} AS events_pct, {pct('pieces')} AS pieces_pct,
                         100 - {pct('fastest')} AS fastest_pct, 100 - {pct('average')} AS average_pct
                  FROM p),
            s AS (SELECT name, {figures}, {medal_counts} FROM good WHERE date IS NOT NULL
                  GROUP BY name)
            SELECT s.name, events, pieces, fastest, round(average, 6) AS average, gold, silver,
                   bronze, round(events_pct, 6) AS events_pct, round(pieces_pct, 6) AS pieces_pct,
                   round(fastest_pct, 6) AS fastest_pct, round(average_pct, 6) AS average_pct,
                   overall_rank, rating_rank, z_rank, percentile_rank,
                   round_even(avg_rank, 2) AS avg_rank,
                   (SELECT count(*) FROM ranking) AS eligible,
                   {span('fastest')} AS fastest_text, {span('average')} AS average_text
            FROM s JOIN q ON s.name = q.name LEFT JOIN ranking ON s.name = ranking.name""",
        "competitor_series": f"""WITH {FACT}, timed AS (
              SELECT *, max(date) OVER (PARTITION BY name) AS newest FROM good
              WHERE seconds IS NOT NULL AND date IS NOT NULL AND full_event IS NOT NULL),
            recent AS (SELECT * FROM timed WHERE date_diff('day', date, newest) <= 547),
            moving AS ({_moving('seconds', 'recent')}),
            spread AS ({_SPREAD.format(rows='recent')})
            SELECT a.name, a.entry_id, a.full_event, a.date, rank, pieces, e.entries,
                   round(CAST(seconds AS DOUBLE) / 3600, 6) AS hours,
                   {hms('CAST(seconds AS DOUBLE) / 3600 * 3600')} AS hours_text,
                   round(moving / 3600, 6) AS average_hours,
                   {hms('moving / 3600 * 3600')} AS average_text,
                   strftime(a.date, '%b %d, %Y') AS day_label, label, spread_date
            FROM (SELECT *, {LETTERED} AS label FROM recent) a
            JOIN moving m ON a.entry_id = m.entry_id
            JOIN spread s ON a.entry_id = s.entry_id
            LEFT JOIN entries e ON a.full_event = e.full_event""",
        "moving_average": f"""WITH {FACT}, dated AS (SELECT * FROM good WHERE date IS NOT NULL)
            SELECT entry_id, name, date, round(moving, 6) AS moving_average
            FROM ({_moving('ppm', 'dated')})""",
        "label_days": f"""WITH {FACT} SELECT entry_id, name, date, {LETTERED} AS label
            FROM good WHERE date IS NOT NULL""",
        "spread_dates": f"""WITH {FACT}, dated AS (SELECT * FROM good WHERE date IS NOT NULL)
            {_SPREAD.format(rows='dated')}""",
        "event_detail": f"""WITH {FACT}, e AS (
              SELECT full_event, count(DISTINCT name) AS entrants, min(seconds) AS fastest,
                     avg(seconds) AS average FROM good GROUP BY full_event),
            own AS (SELECT name, full_event, seconds AS own_seconds FROM (
              SELECT *, row_number() OVER (PARTITION BY name, full_event ORDER BY entry_id) AS nth
              FROM good WHERE full_event IS NOT NULL) WHERE nth = 1)
            SELECT name, own.full_event, own_seconds, entrants, fastest,
                   round(average, 6) AS average, {span('fastest')} AS fastest_text,
                   {span('average')} AS average_text, {span('own_seconds')} AS own_text
            FROM own LEFT JOIN e ON own.full_event = e.full_event""",
        "event_entries": f"WITH {FACT} SELECT full_event, entries FROM entries",
        "history": f"""WITH {FACT} SELECT {HISTORY.format(rows='good')} WHERE date IS NOT NULL""",
        "bad_name_events": f"""WITH {FACT} SELECT DISTINCT full_event FROM r
            WHERE name IS NULL AND full_event IS NOT NULL""",
        "distinct_names": f"WITH {FACT} SELECT DISTINCT name FROM good",
        "snapshot_year": f"""WITH {FACT}, early AS (SELECT entry_id, date FROM r
              WHERE date <= (SELECT max(date) FROM r) - INTERVAL 12 MONTH)
            SELECT entry_id, date FROM early
            WHERE date >= (SELECT max(date) FROM early) - INTERVAL 12 MONTH""",
        "regulars": f"""WITH {FACT}, c AS (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM good),
            d AS (SELECT *, max(date) OVER (PARTITION BY name) AS newest FROM c
                  WHERE k >= 8 AND date IS NOT NULL)
            SELECT entry_id, name, date FROM d WHERE date_diff('day', date, newest) <= 547""",
        "positions": f"""WITH {FACT} SELECT entry_id, round(corrected_time, 6) AS corrected_time,
            row_number() OVER (ORDER BY g.corrected_time ASC NULLS LAST, entry_id) AS position FROM r g""",
        "event_overview": f"""WITH {FACT}, e AS (
              SELECT full_event, count(DISTINCT name) AS entrants,
                     count(DISTINCT name) + CAST(count(*) > count(name) AS BIGINT)
                       AS entrants_with_unknown,
                     min(seconds) AS fastest, avg(seconds) AS average
              FROM r WHERE full_event IS NOT NULL GROUP BY full_event)
            SELECT full_event, entrants, entrants_with_unknown,
                   round({pct('entrants')}, 6) AS entrants_pct, fastest,
                   round((SELECT count(*) FROM r WHERE r.seconds < e.fastest) * 100.0
                         / (SELECT count(*) FROM r), 6) AS fastest_pct,
                   round(average, 6) AS average, round({pct('e.average')}, 6) AS average_pct,
                   {span('fastest')} AS fastest_text, {span('e.average')} AS average_text
            FROM e""",
        "performance_curve": f"""WITH {FACT}, p AS (
              SELECT *, row_number() OVER (PARTITION BY full_event
                          ORDER BY seconds ASC NULLS LAST, entry_id) AS place,
                     count(*) OVER (PARTITION BY full_event) AS n FROM r)
            SELECT full_event, entry_id, name, time_text, date, round(ppm, 6) AS ppm, rank, seconds,
                   round(CAST(seconds AS DOUBLE) / 3600, 6) AS hours,
                   round(CASE WHEN n = 1 THEN 1 ELSE 1 - (place - 1) / CAST(n - 1 AS DOUBLE) END, 6)
                     AS performance FROM p""",
        "leaderboard": f"""WITH {FACT} SELECT full_event, entry_id, name, time_text, date,
            round(ppm, 6) AS ppm, pieces, row_number() OVER (PARTITION BY full_event
              ORDER BY rank ASC NULLS LAST, name ASC NULLS LAST, entry_id) AS position
            FROM r""",
        "density": f"WITH {FACT}, {DENSITY}",
        "attempt_boxes": f"""WITH {FACT}, n AS (SELECT full_event, row_number() OVER (
              PARTITION BY name ORDER BY date ASC NULLS LAST, entry_id) AS a FROM good)
            SELECT full_event, CAST(min(a) AS DOUBLE) AS low,
                   quantile_cont(CAST(a AS DOUBLE), 0.25) AS q1,
                   quantile_cont(CAST(a AS DOUBLE), 0.5) AS median,
                   quantile_cont(CAST(a AS DOUBLE), 0.75) AS q3, CAST(max(a) AS DOUBLE) AS high
            FROM n GROUP BY full_event""",
        "compare_summary": f"{ranked}, {SUMMARY} SELECT * FROM summary",
        "compare_bars": f"""{ranked}, {SUMMARY} SELECT name, last_year_hours, last_year_time,
            last_year_ppm, last_year_events, last_year_seconds FROM summary
            WHERE last_year_seconds IS NOT NULL""",
        "rating_series": f"""WITH {FACT} SELECT name, date, rating_out,
            entry_id FROM good WHERE date IS NOT NULL AND rating_out IS NOT NULL""",
        "ordered_attempts": f"""WITH {FACT} SELECT concat(name, ' ', row_number() OVER (
              ORDER BY seconds ASC NULLS LAST, entry_id) - 1) AS label, name, entry_id, full_event,
            seconds, round(CAST(seconds AS DOUBLE) / 3600, 6) AS hours,
            {clock('seconds')} AS time_hms FROM good""",
        "compare_history": f"WITH {FACT} SELECT {HISTORY.format(rows='good')}",
    }

    kpis = """count(DISTINCT full_event) AS events, count(DISTINCT name) AS competitors,
      count(*) AS attempts, CAST(coalesce(sum(CAST(seconds AS DECIMAL(18, 6))), 0) AS DOUBLE) AS seconds,
      coalesce(sum(pieces), 0) AS pieces"""
    figures_list = ["events", "competitors", "attempts", "seconds", "pieces"]
    before = ", ".join(f"b.{c} AS {c}_before" for c in figures_list)
    growth = ", ".join(f"a.{c} - b.{c} AS {c}_delta" for c in figures_list)
    now = ", ".join(f"a.{c}" for c in figures_list)
    sql |= {
        "totals": f"""WITH {FACT}, a AS (SELECT {kpis} FROM r)
            SELECT *, {span('seconds')} AS seconds_text FROM a""",
        "totals_delta": f"""WITH {FACT}, a AS (SELECT {kpis} FROM r), b AS (SELECT {kpis} FROM r
              WHERE date <= (SELECT max(date) FROM r) - INTERVAL 1 MONTH)
            SELECT {now}, {before}, {growth}, {span('a.seconds')} AS seconds_text,
                   {span('(a.seconds - b.seconds)')} AS seconds_delta_text FROM a, b""",
        "cumulative_competitors": f"WITH {FACT} {_first_dates('name', 'competitors')}",
        "cumulative_events": f"WITH {FACT} {_first_dates('full_event', 'events')}",
        "cumulative_entries": f"""WITH {FACT} SELECT date,
            CAST(sum(count(*)) OVER (ORDER BY date) AS BIGINT) AS attempts
            FROM r WHERE date IS NOT NULL GROUP BY date""",
        "most_frequent": f"""WITH {FACT} SELECT name, count(*) AS attempts FROM good GROUP BY name
            ORDER BY attempts DESC, name LIMIT 20""",
        "time_search": f"""WITH {FACT}, {STATE} SELECT name, avg_12m_text, total_events, full_event,
            date, pace_seconds FROM paces WHERE pace_seconds <= 10800""",
        "time_search_all": f"""WITH {FACT}, {STATE} SELECT name, avg_12m_text, total_events, full_event,
            date, pace_seconds FROM paces""",
        "latest_state": f"""WITH {FACT}, {STATE} SELECT name, date, full_event, total_events,
            avg_12m_text FROM state""",
        "time_search_counts": f"""WITH {FACT}, {STATE} SELECT
            count(*) FILTER (pace_seconds BETWEEN 5400 AND 9000) AS shown,
            count(*) AS competitors, min(pace_seconds) AS smallest FROM paces""",
    }
    tables = [
        "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
        "nation", "orders", "pages", "part", "region", "supplier",
    ]
    counts = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in tables)
    sql |= {
        "build_results_bucketed": STAR,
        "listed_tables": f"{counts} UNION ALL SELECT 'competitors', 0",
        "loaded_results": f"WITH {FACT} SELECT entry_id, name, date, seconds, pieces FROM r",
        "loaded_results_csv": f"""WITH {FACT} SELECT CAST(entry_id AS VARCHAR) AS entry_id, name, full_event, date,
            seconds, rank, rating_out, CAST(total_events AS BIGINT) AS total_events FROM fact""",
        "loaded_rankings": sql["rankings"],
        "sheet_union": f"""WITH {ATTEMPTS}, cells AS (
              SELECT *, substr(event, 1, 7) AS sheet FROM base),
            titles AS (
              SELECT sheet, concat('Title ', min(entry_id), ', "of" ', arg_min(full_event, entry_id)) AS full_event
              FROM cells GROUP BY sheet)
            SELECT concat('sheet=', sheet) AS event, t.full_event, CAST(entry_id AS VARCHAR) AS entry_id, name,
                   {clock('seconds')} AS time,
                   CASE WHEN CAST(substr(sheet, 7, 1) AS INT) % 2 = 1 THEN CAST(CAST(pieces AS BIGINT) AS VARCHAR) END
                     AS pieces
            FROM cells JOIN titles t USING (sheet)""",
        "unread_dates": f"""WITH {ATTEMPTS} SELECT concat('soon ', entry_id % 3) AS text, count(*) AS rows
            FROM base WHERE entry_id % 47 = 0 GROUP BY ALL""",
        "one_competitor": f"""WITH {FACT} SELECT entry_id, name, date, seconds FROM r
            WHERE name = 'Customer#000000010'""",
        "some_competitors": f"WITH {FACT} SELECT entry_id, name FROM r WHERE name LIKE '%7'",
    }
    sql |= {
        f"{name}_split": sql[name]
        for name in (
            "event_stats", "attempt_boxes", "score_attempts", "population_pct", "performance_curve", "leaderboard",
        )
    }
    top = f"""WITH {FACT}, top AS (SELECT name, {medal_counts} FROM good WHERE rank IN (1, 2, 3)
        GROUP BY name ORDER BY count(*) DESC, name LIMIT 20)"""
    sql["top_medalists"] = f"{top} SELECT * FROM top"
    sql["medal_long"] = f"""{top} SELECT name, 'gold' AS medal, gold AS medals FROM top
        UNION ALL SELECT name, 'silver', silver FROM top
        UNION ALL SELECT name, 'bronze', bronze FROM top"""
    return sql
