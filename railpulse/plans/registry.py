"""Named query catalogue: key -> (Spark plan, DuckDB oracle SQL).

Every entry reads the driver's tables through a binding and runs over the
whole tables: the report window used here spans all test data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import ScopeFilter
from railpulse.operators import metrics as M
from railpulse.operators import reports as R
from railpulse.plans import oracle as O
from railpulse.sources.bindings import TpchBinding

# Report window without bounds in practice: whatever the tables hold.
WHOLE = TimeRange.of_dates("1000-01-01", "9998-12-31")
LO, HI = "1000-01-01 00:00:00", "9999-01-01 00:00:00"
WIN = O.win(LO, HI)

SCOPES = ScopeFilter.scopes()
SCOPE_H = ScopeFilter.scope("HSTON")           # -> HEUSTON
STATION = ScopeFilter.station("CNLLY")         # matches CNLLY and cnlly
STATIONS = ScopeFilter.stations(["CNLLY", "HSTON", "ST7"])
NETWORK = ScopeFilter.network()

RAW_VARIANTS = {"network": NETWORK, "stations": STATIONS, "station": STATION}


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None):
    def deco(fn):
        REGISTRY[key] = Entry(fn, sql)
        return fn
    return deco


def _a(spark, sf_dir) -> TpchBinding:
    return TpchBinding(spark, sf_dir)


def _sp(f: ScopeFilter) -> str:
    return O.station_pred(f.kind, f.values)


# ---------------------------------------------------------------------------
# Dashboard and categories
# ---------------------------------------------------------------------------

def _dashboard_sql(scopes) -> str:
    return O.ab(f""",
tp AS (SELECT trip_id, COUNT(*) AS n, MAX(late_minutes) AS peak
       FROM resolved WHERE {WIN} AND late_minutes <= 500 AND {O.scope_pred(scopes)}
       GROUP BY trip_id),
agg AS (SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS total_snapshots,
               CAST(COUNT(*) AS BIGINT) AS unique_trips,
               CAST(COALESCE(SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS delayed_trips,
               CAST(COALESCE(SUM(CASE WHEN peak >= 5 THEN peak ELSE 0 END), 0) AS BIGINT) AS total_delay_minutes,
               CAST(COALESCE(MAX(peak), 0) AS INTEGER) AS max_delay
        FROM tp)
SELECT total_snapshots, unique_trips, delayed_trips, unique_trips - delayed_trips AS on_time_trips,
       total_delay_minutes, max_delay,
       {O.round1(O.ratio('total_delay_minutes', 'delayed_trips'))} AS average_delay,
       {O.prob('delayed_trips', 'unique_trips')} AS delay_probability, {O.band('delayed_trips', 'unique_trips')} AS reliability_band
FROM agg""")


register("dashboard", _dashboard_sql(SCOPES.values))(
    lambda spark, d: R.dashboard(_a(spark, d), WHOLE, SCOPES))
register("dashboard_scope", _dashboard_sql(SCOPE_H.values))(
    lambda spark, d: R.dashboard(_a(spark, d), WHOLE, SCOPE_H))


def _categories_sql(scopes) -> str:
    return O.ab(f""",
tp AS (SELECT trip_id, MAX(late_minutes) AS peak
       FROM resolved WHERE {WIN} AND late_minutes <= 500 AND {O.scope_pred(scopes)}
       GROUP BY trip_id),
w AS (SELECT COALESCE(SUM(CASE WHEN peak BETWEEN 5 AND 9 THEN 1 ELSE 0 END), 0) AS c1,
             COALESCE(SUM(CASE WHEN peak BETWEEN 10 AND 19 THEN 1 ELSE 0 END), 0) AS c2,
             COALESCE(SUM(CASE WHEN peak BETWEEN 20 AND 39 THEN 1 ELSE 0 END), 0) AS c3,
             COALESCE(SUM(CASE WHEN peak >= 40 THEN 1 ELSE 0 END), 0) AS c4
      FROM tp)
SELECT 1 AS ordinal, 'Small Delay (5–9 min)' AS category, CAST(c1 AS BIGINT) AS trips FROM w
UNION ALL SELECT 2, 'Medium Delay (10–19 min)', CAST(c2 AS BIGINT) FROM w
UNION ALL SELECT 3, 'Big Delay (20–39 min)', CAST(c3 AS BIGINT) FROM w
UNION ALL SELECT 4, 'Extreme Delay (40+ min)', CAST(c4 AS BIGINT) FROM w""")


register("delay_categories", _categories_sql(SCOPES.values))(
    lambda spark, d: R.delay_categories(_a(spark, d), WHOLE, SCOPES))
register("delay_categories_scope", _categories_sql(SCOPE_H.values))(
    lambda spark, d: R.delay_categories(_a(spark, d), WHOLE, SCOPE_H))

register("peak_histogram", O.ab(f""",
tp AS (SELECT trip_id, MAX(late_minutes) AS peak
       FROM resolved WHERE {WIN} AND late_minutes <= 500 AND {O.scope_pred(SCOPES.values)}
       GROUP BY trip_id),
c AS (SELECT CASE WHEN peak BETWEEN 0 AND 4 THEN 'On Time'
                  WHEN peak BETWEEN 5 AND 9 THEN 'Small Delay'
                  WHEN peak BETWEEN 10 AND 19 THEN 'Medium Delay'
                  WHEN peak BETWEEN 20 AND 39 THEN 'Big Delay'
                  ELSE 'Extreme Delay' END AS category FROM tp)
SELECT category,
       CASE category WHEN 'On Time' THEN 'On Time'
                     WHEN 'Small Delay' THEN 'Small Delay (5–9 min)'
                     WHEN 'Medium Delay' THEN 'Medium Delay (10–19 min)'
                     WHEN 'Big Delay' THEN 'Big Delay (20–39 min)'
                     ELSE 'Extreme Delay (40+ min)' END AS label,
       COUNT(*) AS trips
FROM c GROUP BY category"""))(lambda spark, d: R.peak_histogram(_a(spark, d), WHOLE, SCOPES))


# ---------------------------------------------------------------------------
# Hourly profile
# ---------------------------------------------------------------------------

def _hourly_sql(source: str, where: str) -> str:
    body = f"""
SELECT CAST(EXTRACT(hour FROM captured_at) AS INTEGER) AS hour,
       printf('%02d:00', CAST(EXTRACT(hour FROM captured_at) AS INTEGER)) AS hour_label,
       COUNT(*) AS total,
       CAST(SUM(CASE WHEN late_minutes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS delayed,
       {O.round1('COALESCE(AVG(CASE WHEN late_minutes > 0 THEN CAST(late_minutes AS DOUBLE) END), 0)')} AS avg_delay,
       {O.prob('SUM(CASE WHEN late_minutes > 0 THEN 1 ELSE 0 END)', 'COUNT(*)')} AS delay_probability
FROM {source} WHERE {where}
GROUP BY 1 ORDER BY 1"""
    return O.ab(body)


register("hourly_scopes", _hourly_sql("resolved", f"{WIN} AND late_minutes <= 500 AND {O.scope_pred(SCOPES.values)}"))(
    lambda spark, d: R.hourly(_a(spark, d), WHOLE, SCOPES))
register("hourly_scope", _hourly_sql("resolved", f"{WIN} AND late_minutes <= 500 AND {O.scope_pred(SCOPE_H.values)}"))(
    lambda spark, d: R.hourly(_a(spark, d), WHOLE, SCOPE_H))
for _name, _f in RAW_VARIANTS.items():
    register(f"hourly_{_name}", _hourly_sql("snapshot", f"{WIN} AND {_sp(_f)}"))(
        lambda spark, d, _f=_f: R.hourly(_a(spark, d), WHOLE, _f))


# ---------------------------------------------------------------------------
# Largest delays / recent delayed trips / recent rows
# ---------------------------------------------------------------------------

def _top10_sql(sel_where: str, lookup_where: str | None = None) -> str:
    """The ten trips that were latest, each with its earliest snapshot at that lateness."""
    return O.ab(f""",
latest_trips AS (
  SELECT trip_id, max(late_minutes) AS worst, count(*) AS seen FROM resolved WHERE {sel_where}
  GROUP BY trip_id HAVING worst >= 5 ORDER BY worst DESC, trip_id LIMIT 10)
SELECT train_code, station_full_name, train_date, sch_depart, sch_arrival, direction, origin, destination,
       worst::INTEGER AS peak_delay, seen AS snapshot_count, strftime(captured_at, '%H:%M') AS captured_hhmm
FROM resolved JOIN latest_trips USING (trip_id)
WHERE late_minutes = worst AND ({lookup_where or sel_where})
QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY captured_at NULLS FIRST, station_full_name NULLS FIRST,
                           sch_depart NULLS FIRST, sch_arrival NULLS FIRST, station_code NULLS FIRST) = 1
ORDER BY worst DESC, trip_id""")


register("top10_scopes", _top10_sql(f"{WIN} AND late_minutes <= 500 AND {O.scope_pred(SCOPES.values)}"))(
    lambda spark, d: R.top_delayed_trips(_a(spark, d), WHOLE, SCOPES))
register("top10_scope", _top10_sql(f"{WIN} AND late_minutes <= 500 AND {O.scope_pred(SCOPE_H.values)}"))(
    lambda spark, d: R.top_delayed_trips(_a(spark, d), WHOLE, SCOPE_H))
register("top10_network", _top10_sql(WIN))(
    lambda spark, d: R.top_delayed_trips(_a(spark, d), WHOLE, NETWORK))
register("top10_stations", _top10_sql(f"{WIN} AND {_sp(STATIONS)}"))(
    lambda spark, d: R.top_delayed_trips(_a(spark, d), WHOLE, STATIONS))
register("top10_station", _top10_sql(f"{WIN} AND {_sp(STATION)}", lookup_where=WIN))(
    lambda spark, d: R.top_delayed_trips(_a(spark, d), WHOLE, STATION))


def _recent5_sql(where: str) -> str:
    return O.ab(f""",
pick AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id
                                      ORDER BY captured_at DESC NULLS LAST, station_full_name DESC NULLS LAST,
                                               late_minutes DESC NULLS LAST, station_code DESC NULLS LAST,
                                               sch_depart DESC NULLS LAST) AS rn
         FROM resolved WHERE late_minutes >= 5 AND {where})
SELECT train_code, station_full_name, late_minutes, strftime(captured_at, '%H:%M') AS captured_hhmm,
       origin, destination
FROM pick WHERE rn = 1
ORDER BY captured_at DESC, trip_id ASC LIMIT 5""")


register("recent5_scopes", _recent5_sql(f"late_minutes <= 500 AND {O.scope_pred(SCOPES.values)}"))(
    lambda spark, d: R.recent_delayed_trips(_a(spark, d), SCOPES))
register("recent5_scope", _recent5_sql(f"late_minutes <= 500 AND {O.scope_pred(SCOPE_H.values)}"))(
    lambda spark, d: R.recent_delayed_trips(_a(spark, d), SCOPE_H))
for _name, _f in RAW_VARIANTS.items():
    register(f"recent5_{_name}", _recent5_sql(_sp(_f)))(
        lambda spark, d, _f=_f: R.recent_delayed_trips(_a(spark, d), _f))

RECENT50_SQL = O.a("""
SELECT s.trip_id, s.station_code, s.station_full_name, s.sch_depart, s.late_minutes, s.captured_at,
       t.train_code, t.train_date, t.train_type, t.origin, t.destination, t.direction
FROM snapshot s LEFT JOIN trip t ON t.trip_id = s.trip_id
WHERE s.late_minutes > 4 AND s.late_minutes <= 500
ORDER BY s.captured_at DESC, s.trip_id ASC, s.station_code ASC, s.sch_depart ASC, s.late_minutes ASC
LIMIT 50""")
register("recent50", RECENT50_SQL)(lambda spark, d: R.recent_delay_rows(_a(spark, d), nested=False))
# The nested form, its trip's fields read out of the nest.
register("recent50_nested", RECENT50_SQL)(
    lambda spark, d: R.recent_delay_rows(_a(spark, d)).select("*", "trip.*").drop("trip"))


# ---------------------------------------------------------------------------
# Destinations and routes
# ---------------------------------------------------------------------------

def _endpoint_sql(names, where: str, missing: str, order: str, limit: int) -> str:
    if missing == "unknown":
        sel = ", ".join(f"COALESCE(NULLIF({n}, ''), 'Unknown') AS {n}" for n in names)
        having_ep = "TRUE"
    else:
        sel = ", ".join(names)
        having_ep = " AND ".join(f"{n} IS NOT NULL AND {n} <> ''" for n in names)
    keys = ", ".join(names)
    band = f", {O.band('delayed_trips', 'total_trips')} AS reliability_band" if len(names) > 1 else ""
    return O.ab(f""",
tp AS (SELECT trip_id, {sel}, MAX(late_minutes) AS peak
       FROM resolved WHERE {where} AND {having_ep}
       GROUP BY ALL),
r AS (SELECT {keys}, COUNT(*) AS total_trips,
             CAST(SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS delayed_trips,
             CAST(SUM(CASE WHEN peak >= 5 THEN peak ELSE 0 END) AS BIGINT) AS total_delay_minutes
      FROM tp GROUP BY {keys}
      HAVING SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) > 0)
SELECT {keys}, total_trips, delayed_trips, total_delay_minutes,
       {O.round1(O.ratio('total_delay_minutes', 'delayed_trips'))} AS average_delay,
       {O.prob('delayed_trips', 'total_trips')} AS delay_probability{band}
FROM r ORDER BY {order} LIMIT {limit}""")


_DEST_ORDER = f"{O.ratio('total_delay_minutes', 'delayed_trips')} DESC, destination ASC"
_ROUTE_ORDER = "total_delay_minutes DESC, origin ASC, destination ASC"
_SCOPED_WHERE = f"{WIN} AND late_minutes <= 500 AND {O.scope_pred(SCOPES.values)}"
_SCOPE_H_WHERE = f"{WIN} AND late_minutes <= 500 AND {O.scope_pred(SCOPE_H.values)}"

register("destinations", _endpoint_sql(["destination"], _SCOPED_WHERE, "unknown", _DEST_ORDER, 10))(
    lambda spark, d: R.destinations(_a(spark, d), WHOLE, SCOPES))
register("destinations_scope", _endpoint_sql(["destination"], _SCOPE_H_WHERE, "unknown", _DEST_ORDER, 10))(
    lambda spark, d: R.destinations(_a(spark, d), WHOLE, SCOPE_H))
register("routes", _endpoint_sql(["origin", "destination"], _SCOPED_WHERE, "unknown", _ROUTE_ORDER, 15))(
    lambda spark, d: R.routes(_a(spark, d), WHOLE, SCOPES))
register("routes_scope", _endpoint_sql(["origin", "destination"], _SCOPE_H_WHERE, "unknown", _ROUTE_ORDER, 15))(
    lambda spark, d: R.routes(_a(spark, d), WHOLE, SCOPE_H))
for _name, _f in RAW_VARIANTS.items():
    _w = f"{WIN} AND {_sp(_f)}"
    register(f"destinations_raw_{_name}", _endpoint_sql(["destination"], _w, "drop", _DEST_ORDER, 10))(
        lambda spark, d, _f=_f: R.destinations(_a(spark, d), WHOLE, _f))
    register(f"routes_raw_{_name}", _endpoint_sql(["origin", "destination"], _w, "drop", _ROUTE_ORDER, 15))(
        lambda spark, d, _f=_f: R.routes(_a(spark, d), WHOLE, _f))


# ---------------------------------------------------------------------------
# Daily delays, train ranking
# ---------------------------------------------------------------------------

register("daily_delays", O.ab(f""",
tp AS (SELECT train_date, trip_id, MIN(captured_at) AS first_seen
       FROM resolved
       WHERE train_date IS NOT NULL AND train_date <> '' AND {WIN} AND late_minutes <= 500
       GROUP BY train_date, trip_id HAVING MAX(late_minutes) >= 5)
SELECT train_date, COUNT(*) AS delayed_trip_count, MIN(first_seen) AS date_seen
FROM tp GROUP BY train_date ORDER BY date_seen DESC, train_date ASC LIMIT 30"""))(
    lambda spark, d: R.daily_delays(_a(spark, d), WHOLE))

register("top_trains", O.ab(f""",
tp AS (SELECT trip_id, train_code, MAX(late_minutes) AS peak
       FROM resolved WHERE late_minutes <= 500 GROUP BY trip_id, train_code)
SELECT train_code, CAST(SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS delayed_trips,
       {O.round1('COALESCE(AVG(CASE WHEN peak >= 5 THEN CAST(peak AS DOUBLE) END), 0)')} AS average_delay,
       CAST(MAX(peak) AS INTEGER) AS max_delay
FROM tp GROUP BY train_code
ORDER BY delayed_trips DESC, COALESCE(AVG(CASE WHEN peak >= 5 THEN CAST(peak AS DOUBLE) END), 0) DESC,
         train_code ASC
LIMIT 10"""))(lambda spark, d: R.top_trains(_a(spark, d)))


# ---------------------------------------------------------------------------
# Daily metrics and station ranking
# ---------------------------------------------------------------------------

# Grain: date, scope, station, route.  Each trip counts once in a row, with its peak there.
METRICS_CTE = """,
worst AS (
  SELECT captured_at::DATE AS service_date, scope AS service_scope, upper(station_code) AS station_code,
         ifnull(nullif(origin, ''), 'Unknown') AS origin, ifnull(nullif(destination, ''), 'Unknown') AS destination,
         max(station_full_name) AS name, count(*) AS readings, max(late_minutes) AS peak
  FROM resolved WHERE late_minutes <= 500
  GROUP BY captured_at::DATE, scope, upper(station_code), ifnull(nullif(origin, ''), 'Unknown'),
           ifnull(nullif(destination, ''), 'Unknown'), trip_id),
metrics AS (
  SELECT service_date, service_scope, station_code, max(name) AS station_full_name, origin, destination,
         sum(readings)::BIGINT AS total_snapshots,
         count(*) AS unique_trips,
         count(*) FILTER (peak >= 5) AS delayed_trips,
         count(*) FILTER (peak < 5) AS on_time_trips,
         ifnull(avg(peak::DOUBLE) FILTER (peak >= 5), 0) AS average_delay_minutes,
         max(peak)::INTEGER AS max_delay_minutes,
         ifnull(sum(peak) FILTER (peak >= 5), 0)::BIGINT AS total_delay_minutes,
         count(*) FILTER (peak BETWEEN 5 AND 9) AS small_delay_trips,
         count(*) FILTER (peak BETWEEN 10 AND 19) AS medium_delay_trips,
         count(*) FILTER (peak BETWEEN 20 AND 39) AS big_delay_trips,
         count(*) FILTER (peak >= 40) AS extreme_delay_trips
  FROM worst GROUP BY service_date, service_scope, station_code, origin, destination)
"""

register("daily_metrics", O.ab(METRICS_CTE + "SELECT * FROM metrics"))(
    lambda spark, d: M.build_daily_metrics(_a(spark, d), with_updated_at=False))


def _ranking_sql(scopes, limit: int | None) -> str:
    lim = f"LIMIT {limit}" if limit else ""
    return O.ab(METRICS_CTE + f"""
SELECT station_code, MAX(station_full_name) AS station_full_name,
       CAST(COALESCE(SUM(unique_trips), 0) AS BIGINT) AS total_trips,
       CAST(COALESCE(SUM(delayed_trips), 0) AS BIGINT) AS delayed_trips,
       {O.round1(O.ratio('SUM(total_delay_minutes)', 'SUM(delayed_trips)'))} AS average_delay,
       {O.prob('SUM(delayed_trips)', 'SUM(unique_trips)')} AS delay_probability,
       {O.band('SUM(delayed_trips)', 'SUM(unique_trips)')} AS reliability_band,
       CAST(COALESCE(SUM(total_delay_minutes), 0) AS BIGINT) AS total_delay_minutes
FROM metrics
WHERE service_date >= DATE '{WHOLE.start_date}' AND service_date < DATE '{WHOLE.end_date_exclusive}'
  AND service_scope IN ({", ".join(f"'{s}'" for s in scopes)})
GROUP BY station_code
ORDER BY delayed_trips DESC, {O.ratio('SUM(total_delay_minutes)', 'SUM(delayed_trips)')} DESC, station_code ASC
{lim}""")


def _ranking(filt, limit):
    def run(spark, d):
        return M.station_ranking(M.build_daily_metrics(_a(spark, d), with_updated_at=False),
                                 WHOLE, filt, limit)
    return run


register("station_ranking", _ranking_sql(SCOPES.values, None))(_ranking(SCOPES, None))
register("station_ranking_top15", _ranking_sql(SCOPES.values, 15))(_ranking(SCOPES, 15))
register("station_ranking_scope", _ranking_sql(SCOPE_H.values, None))(_ranking(SCOPE_H, None))
register("station_ranking_scope_top15", _ranking_sql(SCOPE_H.values, 15))(_ranking(SCOPE_H, 15))


# ---------------------------------------------------------------------------
# Raw counters and raw station statistics
# ---------------------------------------------------------------------------

for _name, _f in RAW_VARIANTS.items():
    _w = f"{WIN} AND {_sp(_f)}"
    register(f"snapshot_count_{_name}", O.a(f"SELECT COUNT(*) AS snapshots FROM snapshot WHERE {_w}"))(
        lambda spark, d, _f=_f: R.snapshot_count(_a(spark, d), WHOLE, _f))
    register(f"max_delay_{_name}", O.a(f"SELECT MAX(late_minutes) AS max_delay FROM snapshot WHERE {_w}"))(
        lambda spark, d, _f=_f: R.max_delay(_a(spark, d), WHOLE, _f))
    register(f"unique_trips_{_name}", O.a(
        f"SELECT COUNT(DISTINCT trip_id) AS unique_trips FROM snapshot WHERE {_w}"))(
        lambda spark, d, _f=_f: R.unique_trips(_a(spark, d), WHOLE, _f))
    register(f"delayed_trips_{_name}", O.a(f"""
SELECT COUNT(*) AS delayed_trips FROM (
  SELECT trip_id FROM snapshot WHERE {_w} GROUP BY trip_id HAVING MAX(late_minutes) >= 5) x"""))(
        lambda spark, d, _f=_f: R.delayed_trips(_a(spark, d), WHOLE, _f))
    register(f"avg_peak_delay_{_name}", O.a(f"""
SELECT COALESCE(AVG(CAST(peak AS DOUBLE)), 0) AS avg_peak_delay FROM (
  SELECT MAX(late_minutes) AS peak FROM snapshot WHERE {_w} GROUP BY trip_id
  HAVING MAX(late_minutes) >= 5) x"""))(
        lambda spark, d, _f=_f: R.avg_peak_delay(_a(spark, d), WHOLE, _f))
    register(f"peak_delays_{_name}", O.a(f"""
SELECT MAX(late_minutes) AS peak_delay FROM snapshot WHERE {_w}
GROUP BY trip_id HAVING MAX(late_minutes) >= 5"""))(
        lambda spark, d, _f=_f: R.peak_delays(_a(spark, d), WHOLE, _f))


def _station_stats_sql(where: str, limit: int | None) -> str:
    lim = f"LIMIT {limit}" if limit else ""
    return O.a(f""",
st AS (SELECT station_code, station_full_name, trip_id, MAX(late_minutes) AS peak
       FROM snapshot WHERE {where} GROUP BY station_code, station_full_name, trip_id),
r AS (SELECT station_code, station_full_name, COUNT(*) AS total_trips,
             CAST(SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS delayed_trips,
             CAST(SUM(CASE WHEN peak >= 5 THEN peak ELSE 0 END) AS BIGINT) AS total_delay_minutes
      FROM st GROUP BY station_code, station_full_name)
SELECT station_code, station_full_name, total_trips, delayed_trips,
       {O.round1(O.ratio('total_delay_minutes', 'delayed_trips'))} AS average_delay,
       {O.prob('delayed_trips', 'total_trips')} AS delay_probability, {O.band('delayed_trips', 'total_trips')} AS reliability_band,
       total_delay_minutes
FROM r
ORDER BY delayed_trips DESC, {O.ratio('total_delay_minutes', 'delayed_trips')} DESC,
         station_code ASC, station_full_name ASC
{lim}""")


for _name, _f in (("network", NETWORK), ("stations", STATIONS)):
    _w = f"{WIN} AND {_sp(_f)}"
    register(f"station_stats_top15_{_name}", _station_stats_sql(_w, 15))(
        lambda spark, d, _f=_f: R.station_stats(_a(spark, d), WHOLE, _f, limit=15))
    register(f"station_stats_all_{_name}", _station_stats_sql(_w, None))(
        lambda spark, d, _f=_f: R.station_stats(_a(spark, d), WHOLE, _f, limit=None))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}


# ---------------------------------------------------------------------------
# Legacy composite-key family
# ---------------------------------------------------------------------------

from railpulse.operators import legacy as L  # noqa: E402

REC = "rec AS (SELECT s.*, t.train_code, t.train_date, t.train_type, t.origin, t.destination, t.direction " \
      "FROM snapshot s JOIN trip t ON t.trip_id = s.trip_id)"
LKEY = "train_code, station_code, train_date, sch_depart"


def _rec(body: str) -> str:
    return O.with_views(body, O.TRIP_VIEW, O.SNAPSHOT_VIEW, REC)


register("legacy_records", _rec("""
SELECT train_code, station_code, station_full_name, train_date, sch_depart, sch_arrival,
       CAST(NULL AS VARCHAR) AS exp_depart, CAST(NULL AS VARCHAR) AS exp_arrival, CAST(NULL AS VARCHAR) AS status,
       late_minutes, captured_at, train_type, origin, destination, direction FROM rec"""))(
    lambda spark, d: L.records(_a(spark, d)))
for _name, _f in (("network", NETWORK), ("station", STATION)):
    _w = f"{WIN} AND {_sp(_f)}"
    register(f"legacy_record_count_{_name}", _rec(f"SELECT COUNT(*) AS records FROM rec WHERE {_w}"))(
        lambda spark, d, _f=_f: L.record_count(_a(spark, d), WHOLE, _f))
    register(f"legacy_max_delay_{_name}", _rec(f"SELECT MAX(late_minutes) AS max_delay FROM rec WHERE {_w}"))(
        lambda spark, d, _f=_f: L.max_delay(_a(spark, d), WHOLE, _f))
    register(f"legacy_unique_trips_{_name}", _rec(
        f"SELECT COUNT(*) AS unique_trips FROM (SELECT DISTINCT {LKEY} FROM rec WHERE {_w}) x"))(
        lambda spark, d, _f=_f: L.unique_trips(_a(spark, d), WHOLE, _f))
    register(f"legacy_delayed_trips_{_name}", _rec(f"""
SELECT COUNT(*) AS delayed_trips FROM (SELECT 1 FROM rec WHERE {_w} GROUP BY {LKEY}
                                       HAVING MAX(late_minutes) >= 5) x"""))(
        lambda spark, d, _f=_f: L.delayed_trips(_a(spark, d), WHOLE, _f))
    register(f"legacy_avg_peak_{_name}", _rec(f"""
SELECT COALESCE(AVG(CAST(peak AS DOUBLE)), 0) AS avg_peak_delay FROM (
  SELECT MAX(late_minutes) AS peak FROM rec WHERE {_w} GROUP BY {LKEY} HAVING MAX(late_minutes) >= 5) x"""))(
        lambda spark, d, _f=_f: L.avg_peak(_a(spark, d), WHOLE, _f))
    register(f"legacy_peak_delays_{_name}", _rec(f"""
SELECT CAST(MAX(late_minutes) AS INTEGER) AS peak_delay FROM rec WHERE {_w}
GROUP BY {LKEY} HAVING MAX(late_minutes) >= 5"""))(
        lambda spark, d, _f=_f: L.peak_delays(_a(spark, d), WHOLE, _f))


def _legacy_station_sql(limit):
    lim = f"LIMIT {limit}" if limit else ""
    return _rec(f""",
g AS (SELECT station_code, station_full_name, train_code, train_date, sch_depart, MAX(late_minutes) AS peak
      FROM rec WHERE {WIN} GROUP BY station_code, station_full_name, train_code, train_date, sch_depart),
r AS (SELECT station_code, station_full_name, COUNT(*) AS total_trips,
             CAST(SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS delayed_trips,
             SUM(CASE WHEN peak >= 5 THEN peak ELSE 0 END) AS tot
      FROM g GROUP BY station_code, station_full_name)
SELECT station_code, station_full_name, total_trips, delayed_trips,
       {O.round1(O.ratio('tot', 'delayed_trips'))} AS average_delay,
       {O.prob('delayed_trips', 'total_trips')} AS delay_probability
FROM r ORDER BY delayed_trips DESC, {O.ratio('tot', 'delayed_trips')} DESC, station_code, station_full_name
{lim}""")


register("legacy_station_stats_top15", _legacy_station_sql(15))(
    lambda spark, d: L.station_stats(_a(spark, d), WHOLE, limit=15))
register("legacy_station_stats_all", _legacy_station_sql(None))(
    lambda spark, d: L.station_stats(_a(spark, d), WHOLE, limit=None))
register("legacy_hourly", _rec(f"""
SELECT CAST(EXTRACT(hour FROM captured_at) AS INTEGER) AS hour,
       printf('%02d:00', CAST(EXTRACT(hour FROM captured_at) AS INTEGER)) AS hour_label,
       COUNT(*) AS total,
       CAST(SUM(CASE WHEN late_minutes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS delayed,
       {O.round1('COALESCE(AVG(CASE WHEN late_minutes > 0 THEN CAST(late_minutes AS DOUBLE) END), 0)')} AS avg_delay,
       {O.prob('SUM(CASE WHEN late_minutes > 0 THEN 1 ELSE 0 END)', 'COUNT(*)')} AS delay_probability
FROM rec WHERE {WIN} GROUP BY 1 ORDER BY 1"""))(lambda spark, d: L.hourly(_a(spark, d), WHOLE))
register("legacy_top10", _rec(f"""
SELECT train_code, station_full_name, train_date, sch_depart, sch_arrival, direction, origin, destination,
       CAST(MAX(late_minutes) AS INTEGER) AS peak_delay, COUNT(*) AS snapshot_count
FROM rec WHERE {WIN}
GROUP BY train_code, station_full_name, train_date, sch_depart, sch_arrival, direction, origin, destination
HAVING MAX(late_minutes) >= 5
ORDER BY peak_delay DESC, train_code ASC NULLS FIRST, station_full_name ASC NULLS FIRST,
         train_date ASC NULLS FIRST, sch_depart ASC NULLS FIRST, sch_arrival ASC NULLS FIRST,
         direction ASC NULLS FIRST, origin ASC NULLS FIRST, destination ASC NULLS FIRST
LIMIT 10"""))(lambda spark, d: L.top10(_a(spark, d), WHOLE))
register("legacy_destinations", _rec(f""",
g AS (SELECT destination, {LKEY}, MAX(late_minutes) AS peak FROM rec
      WHERE destination IS NOT NULL AND destination <> '' AND {WIN}
      GROUP BY destination, {LKEY}),
r AS (SELECT destination, COUNT(*) AS total_trips,
             CAST(SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS delayed_trips,
             SUM(CASE WHEN peak >= 5 THEN peak ELSE 0 END) AS tot
      FROM g GROUP BY destination HAVING SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) > 0)
SELECT destination, total_trips, delayed_trips, {O.round1(O.ratio('tot', 'delayed_trips'))} AS average_delay,
       {O.prob('delayed_trips', 'total_trips')} AS delay_probability
FROM r ORDER BY {O.ratio('tot', 'delayed_trips')} DESC, destination LIMIT 10"""))(
    lambda spark, d: L.destinations(_a(spark, d), WHOLE))
register("legacy_daily_delays", _rec(f""",
g AS (SELECT train_date, train_code, station_code, sch_depart, MIN(captured_at) AS first_seen
      FROM rec WHERE train_date IS NOT NULL AND train_date <> '' AND {WIN}
      GROUP BY train_date, train_code, station_code, sch_depart HAVING MAX(late_minutes) >= 5)
SELECT train_date, COUNT(*) AS delayed_trip_count, MIN(first_seen) AS date_seen
FROM g GROUP BY train_date ORDER BY date_seen DESC, train_date LIMIT 30"""))(
    lambda spark, d: L.daily_delays(_a(spark, d), WHOLE))
register("legacy_daily_simple", _rec("""
SELECT train_date, COUNT(*) AS delayed_trip_count FROM (
  SELECT train_date FROM rec WHERE train_date IS NOT NULL AND train_date <> ''
  GROUP BY train_date, train_code, station_code, sch_depart HAVING MAX(late_minutes) > 0) x
GROUP BY train_date ORDER BY train_date DESC LIMIT 30"""))(lambda spark, d: L.daily_simple(_a(spark, d)))
register("legacy_top_trains", _rec(f""",
g AS (SELECT train_code, train_type, station_code, train_date, sch_depart, MAX(late_minutes) AS peak
      FROM rec GROUP BY train_code, train_type, station_code, train_date, sch_depart)
SELECT train_code, CAST(SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS delayed_trips,
       {O.round1('COALESCE(AVG(CASE WHEN peak >= 5 THEN CAST(peak AS DOUBLE) END), 0)')} AS average_delay,
       CAST(MAX(peak) AS INTEGER) AS max_delay
FROM g GROUP BY train_code
ORDER BY delayed_trips DESC, COALESCE(AVG(CASE WHEN peak >= 5 THEN CAST(peak AS DOUBLE) END), 0) DESC, train_code
LIMIT 10"""))(lambda spark, d: L.top_trains(_a(spark, d)))
register("legacy_recent50", _rec("""
SELECT train_code, station_code, station_full_name, train_date, sch_depart, late_minutes, captured_at,
       origin, destination
FROM rec WHERE late_minutes > 4
ORDER BY captured_at DESC, train_code, station_code, sch_depart, late_minutes, train_date LIMIT 50"""))(
    lambda spark, d: L.recent_rows(_a(spark, d)))


# ---------------------------------------------------------------------------
# Batch data operations (binding B and A)
# ---------------------------------------------------------------------------

import datetime as _dt  # noqa: E402

from railpulse.functions.scope import overview_code_col, resolve_scope  # noqa: E402
from railpulse.operators import dataops as D  # noqa: E402
from railpulse.sources.bindings import polls as _polls  # noqa: E402

POLL_KEY = ("train_code", "station_code", "train_date", "sch_depart")
AS_OF = _dt.datetime(2001, 6, 1, 3, 0, 0)
CUTOFF = D.retention_cutoff(AS_OF)
UPSERT_SPLIT = "2024-01-15 00:00:00"


def _state_changes_sql(reset: bool) -> str:
    day = "CAST(captured_at - INTERVAL 3 HOUR AS DATE)" if reset else "NULL"
    return O.b(f""",
x AS (SELECT *, LAG(late_minutes) OVER (PARTITION BY {", ".join(POLL_KEY)}, {day}
                                        ORDER BY captured_at, poll_id) AS prev FROM poll)
SELECT poll_id, train_code, station_code, train_date, sch_depart, late_minutes, captured_at, train_type,
       origin, destination, direction
FROM x WHERE prev IS DISTINCT FROM late_minutes""")


register("state_changes", _state_changes_sql(True))(
    lambda spark, d: D.state_changes(_polls(spark, d), key=POLL_KEY))
register("state_changes_no_reset", _state_changes_sql(False))(
    lambda spark, d: D.state_changes(_polls(spark, d), key=POLL_KEY, reset_hour=None))

register("trip_upsert", O.b(f""",
x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY train_code, train_date ORDER BY captured_at, poll_id) AS rn
      FROM poll)
SELECT train_code, train_date, train_type, origin, destination, direction FROM x WHERE rn = 1"""))(
    lambda spark, d: D.upsert_trips(
        D.first_write_trips(_polls(spark, d).where(F.col("captured_at") < F.lit(UPSERT_SPLIT).cast("timestamp_ntz"))),
        _polls(spark, d).where(F.col("captured_at") >= F.lit(UPSERT_SPLIT).cast("timestamp_ntz"))))

register("orphan_trips", O.a("""
SELECT trip_id, train_code, train_date FROM trip
WHERE NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.trip_id = trip.trip_id)"""))(
    lambda spark, d: D.orphan_trips(_a(spark, d).trips(), _a(spark, d).snapshots())
    .select("trip_id", "train_code", "train_date"))

register("snapshots_retained", O.a(f"""
SELECT trip_id, station_code, late_minutes, captured_at FROM snapshot
WHERE captured_at >= TIMESTAMP '{CUTOFF:%Y-%m-%d %H:%M:%S}'"""))(
    lambda spark, d: D.snapshots_retained(_a(spark, d).snapshots(), AS_OF)
    .select("trip_id", "station_code", "late_minutes", "captured_at"))

register("metrics_retained", O.ab(METRICS_CTE + f"""
SELECT * FROM metrics WHERE service_date >= DATE '{CUTOFF.date()}'"""))(
    lambda spark, d: M.metrics_retained(M.build_daily_metrics(_a(spark, d), with_updated_at=False),
                                        CUTOFF.date()))

register("service_hours", O.b("""
SELECT poll_id, train_code, station_code, captured_at FROM poll
WHERE strftime(captured_at, '%H:%M:%S.%f') > '05:59:59.000000'
   OR strftime(captured_at, '%H:%M:%S.%f') < '00:31:00.000000'"""))(
    lambda spark, d: _polls(spark, d).where(D.in_service_hours())
    .select("poll_id", "train_code", "station_code", "captured_at"))

register("scope_resolution", O.ab("""
SELECT service_scope, scope AS resolved_scope, UPPER(station_code) = 'HSTON' AS at_heuston,
       CASE WHEN UPPER(scope) = 'HEUSTON' THEN 'HSTON' WHEN UPPER(scope) = 'CONNOLLY' THEN 'CNLLY'
            ELSE 'OVERVIEW' END AS overview_code,
       COUNT(*) AS snapshots
FROM resolved GROUP BY 1, 2, 3, 4"""))(
    # Counted per trip first, so that the join is at trip and station grain.
    lambda spark, d: _a(spark, d).snapshots().groupBy("trip_id", "service_scope", "station_code")
    .agg(F.count(F.lit(1)).alias("n")).join(_a(spark, d).trips(), "trip_id")
    .groupBy("service_scope", resolve_scope().alias("resolved_scope"),
             (F.upper("station_code") == "HSTON").alias("at_heuston"))
    .agg(F.sum("n").alias("snapshots"))
    .withColumn("overview_code", overview_code_col("resolved_scope")))


# ---------------------------------------------------------------------------
# Landed payloads (binding C): station catalogue and live boards
# ---------------------------------------------------------------------------

from railpulse.operators import catalog as C  # noqa: E402
from railpulse.operators import live as LV  # noqa: E402
from railpulse.sources import payloads as P  # noqa: E402

STN_VIEW = """
stn AS (
  SELECT s_suppkey AS sid,
         CASE (s_suppkey // 20) % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'M' ELSE 'S' END AS station_type,
         s_name AS station_desc,
         CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN NULL
              ELSE 'Alias ' || CAST(s_suppkey AS VARCHAR) END AS station_alias,
         s_acctbal / 100.0 AS latitude, -s_acctbal / 200.0 AS longitude,
         CASE WHEN s_suppkey % 20 = 0 THEN 'HSTON' WHEN s_suppkey % 20 = 1 THEN 'CNLLY'
              WHEN s_suppkey % 20 = 2 THEN 'cnlly' ELSE 'ST' || CAST(s_suppkey % 20 AS VARCHAR) END AS station_code,
         CAST(s_suppkey AS INTEGER) AS station_id,
         UPPER(TRIM(COALESCE(CASE WHEN s_suppkey % 20 = 0 THEN 'HSTON' WHEN s_suppkey % 20 = 1 THEN 'CNLLY'
              WHEN s_suppkey % 20 = 2 THEN 'cnlly' ELSE 'ST' || CAST(s_suppkey % 20 AS VARCHAR) END, ''))) AS code
  FROM supplier),
dflt AS (SELECT * FROM (VALUES ('CNLLY', 'Dublin Connolly', 'Connolly'), ('HSTON', 'Dublin Heuston', 'Heuston'))
         AS v(station_code, station_desc, station_alias)),
cl AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY sid) AS rn
                      FROM stn WHERE station_type = 'D' AND code <> '') x WHERE rn = 1),
cl2 AS (SELECT station_desc, station_alias, latitude, longitude, station_code, station_id, code FROM cl
        UNION ALL
        SELECT station_desc, station_alias, 0.0, 0.0, station_code, 0, station_code FROM dflt
        WHERE station_code = 'CNLLY' AND NOT EXISTS (SELECT 1 FROM cl WHERE UPPER(cl.station_code) = 'CNLLY')),
hl AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code
                                                   ORDER BY CASE station_type WHEN 'M' THEN 0 ELSE 1 END, sid) AS rn
                      FROM stn WHERE station_type IN ('M', 'S') AND code <> '') x WHERE rn = 1),
hl2 AS (SELECT station_desc, station_alias, latitude, longitude, station_code, station_id, code FROM hl
        UNION ALL
        SELECT station_desc, station_alias, 0.0, 0.0, station_code, 0, station_code FROM dflt
        WHERE station_code = 'HSTON' AND NOT EXISTS (SELECT 1 FROM hl WHERE UPPER(hl.station_code) = 'HSTON')),
allst AS (SELECT * FROM cl2 UNION ALL SELECT * FROM hl2 WHERE code NOT IN (SELECT code FROM cl2)),
roles AS (SELECT code, 'CONNOLLY' AS service_scope FROM cl2 UNION ALL SELECT code, 'HEUSTON' FROM hl2)"""

LIVE_VIEW = """
lv AS (SELECT s.trip_id, s.captured_at, s.station_code AS board_station, t.train_code, s.station_full_name,
              s.station_code, strftime(s.captured_at, '%H:%M:%S') AS query_time, t.train_date, t.origin,
              t.destination, 'En Route' AS status, CAST(s.trip_id % 30 AS INTEGER) AS due_in, s.late_minutes,
              s.sch_depart, t.direction,
              CASE t.train_type WHEN '5-LOW' THEN 'Bus' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'DART' END AS train_type
       FROM snapshot s JOIN trip t ON t.trip_id = s.trip_id)"""

STN_COLS = "station_desc, station_alias, latitude, longitude, station_code, station_id"
LIVE_OUT = ("board_station", "train_code", "station_full_name", "station_code", "query_time", "train_date",
            "origin", "destination", "status", "due_in", "late_minutes", "sch_depart", "direction", "train_type")
LIVE_OUT_SQL = ", ".join(LIVE_OUT)
HEU = ("(LOWER(COALESCE(origin, '')) LIKE '%heuston%' OR LOWER(COALESCE(destination, '')) LIKE '%heuston%')")


def _stn(body: str) -> str:
    return O.with_views(body, STN_VIEW)


def _lv(body: str, *extra) -> str:
    return O.with_views(body, O.TRIP_VIEW, O.SNAPSHOT_VIEW, LIVE_VIEW, *extra)


def _catalog(spark, d):
    return P.parse_stations(P.station_payloads(spark, d))


def _stations_out(df):
    return df.orderBy("_ord").select(*C.STATION_COLS)


def _live_rows(spark, d, columns=None):
    return P.parse_live(P.live_payloads(spark, d).withColumnRenamed("station_code", "board_station"), columns=columns)


register("station_catalog", _stn(f"""
SELECT {STN_COLS}, CASE WHEN station_alias IS NOT NULL AND TRIM(station_alias) <> '' THEN station_alias
                       ELSE station_desc END AS display_name
FROM stn WHERE station_type = 'D'"""))(
    lambda spark, d: C.with_display_name(_stations_out(C.stations_by_type(_catalog(spark, d), " d "))))
register("station_catalog_types", _stn(f"SELECT {STN_COLS} FROM hl"))(
    lambda spark, d: _stations_out(C.stations_by_types(_catalog(spark, d), "M, S,")))
register("collection_stations", _stn(f"SELECT {STN_COLS} FROM allst"))(
    lambda spark, d: _stations_out(C.all_collection_stations(_catalog(spark, d))))
register("tracked_stations", _stn(f"SELECT {STN_COLS} FROM allst WHERE code IN ('CNLLY', 'HSTON')"))(
    lambda spark, d: _stations_out(C.tracked_stations(_catalog(spark, d))))
register("station_roles", _stn("SELECT code, service_scope FROM roles"))(
    lambda spark, d: C.station_roles(_catalog(spark, d)))

register("live_rows", _lv(f"SELECT {LIVE_OUT_SQL} FROM lv"))(
    lambda spark, d: _live_rows(spark, d, LIVE_OUT).select(*LIVE_OUT))
_LATEST = """,
latest AS (SELECT lv.* FROM lv JOIN (SELECT board_station AS b, MAX(captured_at) AS m FROM lv GROUP BY 1) x
           ON x.b = lv.board_station AND x.m = lv.captured_at),
board AS (SELECT * FROM latest WHERE LOWER(COALESCE(train_type, '')) <> 'bus'
          AND (UPPER(TRIM(board_station)) = 'HSTON' OR NOT """ + HEU + "))"
register("live_board", _lv(_LATEST + f"\nSELECT {LIVE_OUT_SQL} FROM board"))(
    lambda spark, d: LV.board_rows(P.live_payloads(spark, d, newest=True)).select(*LIVE_OUT))
register("live_board_counts", _lv(_LATEST + """
SELECT board_station, COUNT(*) AS trains,
       CAST(SUM(CASE WHEN late_minutes >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS late_trains,
       COUNT(*) - CAST(SUM(CASE WHEN late_minutes >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS on_time_trains
FROM board GROUP BY board_station"""))(
    lambda spark, d: LV.board_counts(LV.board_rows(P.live_payloads(spark, d, newest=True))))
register("collect_routed", O.with_views(f"""
SELECT {", ".join("lv." + c for c in LIVE_OUT)}, r.service_scope
FROM lv JOIN roles r ON r.code = UPPER(TRIM(COALESCE(lv.board_station, '')))
WHERE LOWER(COALESCE(lv.train_type, '')) <> 'bus'
  AND CASE WHEN r.service_scope = 'HEUSTON' THEN {HEU} OR r.code = 'HSTON' ELSE NOT {HEU} END""",
    O.TRIP_VIEW, O.SNAPSHOT_VIEW, LIVE_VIEW, STN_VIEW))(
    lambda spark, d: LV.route_live_rows(_live_rows(spark, d, LIVE_OUT), _catalog(spark, d))
    .select(*LIVE_OUT, "service_scope"))
register("live_row_scalars", _lv("""
SELECT train_code, station_code, late_minutes, due_in,
       CASE WHEN late_minutes BETWEEN 0 AND 4 THEN 'On Time' WHEN late_minutes BETWEEN 5 AND 9 THEN 'Small Delay'
            WHEN late_minutes BETWEEN 10 AND 19 THEN 'Medium Delay' WHEN late_minutes BETWEEN 20 AND 39 THEN 'Big Delay'
            ELSE 'Extreme Delay' END AS category,
       CASE WHEN late_minutes BETWEEN 0 AND 4 THEN 'On Time'
            WHEN late_minutes BETWEEN 5 AND 9 THEN 'Small Delay (5–9 min)'
            WHEN late_minutes BETWEEN 10 AND 19 THEN 'Medium Delay (10–19 min)'
            WHEN late_minutes BETWEEN 20 AND 39 THEN 'Big Delay (20–39 min)'
            ELSE 'Extreme Delay (40+ min)' END AS category_label,
       late_minutes >= 5 AS is_late,
       CASE WHEN due_in = 0 THEN 'A chegar' ELSE CAST(due_in AS VARCHAR) || ' min' END AS due_in_display
FROM lv"""))(lambda spark, d: LV.live_scalars(_live_rows(spark, d, LV.SCALAR_FIELDS)))


# ---------------------------------------------------------------------------
# Streaming: the change filter as a stateful stream over landed poll documents
# ---------------------------------------------------------------------------

from railpulse.streaming.jobs import stream_state_changes  # noqa: E402

register("stream_state_changes", O.b(""",
x AS (SELECT *, LAG(late_minutes) OVER (PARTITION BY train_code, station_code, train_date,
                                                     CAST(captured_at - INTERVAL 3 HOUR AS DATE)
                                        ORDER BY captured_at, poll_id) AS prev FROM poll)
SELECT train_code, station_code, train_date, late_minutes, captured_at
FROM x WHERE prev IS DISTINCT FROM late_minutes"""))(stream_state_changes)


# The collector over the same polls: what one scope stores, its trips and its metrics.  A second stream over the same
# documents, begun half way, adds the first reading of each key again only where the store does not have it.
from railpulse.streaming import jobs as J  # noqa: E402

COLLECTED_VIEW = f"""
taken AS (
  SELECT *, 'CONNOLLY' AS service_scope, 'Station ' || station_code AS station_full_name, strftime(captured_at, '%H:%M') AS sch_arrival,
         strftime(captured_at, '%H:%M:%S') AS exp_arrival, CASE WHEN poll_id % 3 = 0 THEN '' ELSE strftime(captured_at, '%M:%S') END AS exp_depart,
         CASE WHEN late_minutes > 0 THEN 'Late' ELSE 'En Route' END AS status
  FROM poll
  WHERE (captured_at::TIME > TIME '05:59:59' OR captured_at::TIME < TIME '00:31:00')
    AND lower(ifnull(train_type, '')) <> 'bus' AND NOT {HEU}),
changes AS (
  SELECT *, lag(late_minutes) OVER (PARTITION BY train_code, station_code, train_date, (captured_at - INTERVAL 3 HOUR)::DATE
                                    ORDER BY captured_at, poll_id) AS before FROM taken),
stored AS (SELECT *, captured_at::DATE AS service_date FROM changes WHERE before IS DISTINCT FROM late_minutes),
trips AS (
  SELECT train_code, train_date, train_type, origin, destination, direction FROM stored
  QUALIFY row_number() OVER (PARTITION BY train_code, train_date ORDER BY captured_at, poll_id) = 1),
readings AS (
  SELECT t.*, true AS has_trip, s.station_code, s.station_full_name, s.service_scope, s.sch_depart, s.sch_arrival, s.exp_depart,
         s.exp_arrival, s.status, s.late_minutes, s.captured_at, s.service_date
  FROM stored s JOIN trips t ON t.train_code = s.train_code AND t.train_date = s.train_date)"""

register("collect", O.with_views("SELECT * FROM readings", O.POLL_VIEW, COLLECTED_VIEW))(J.collect)
register("maintain", O.with_views(f"""
SELECT * FROM readings
WHERE captured_at >= TIMESTAMP '{J.MAINTAIN_AS_OF - _dt.timedelta(days=J.MAINTAIN_DAYS)}'""", O.POLL_VIEW, COLLECTED_VIEW))(J.maintained)
register("metrics_refresh_date", O.with_views("SELECT * FROM metrics", O.POLL_VIEW, COLLECTED_VIEW, """
resolved AS (SELECT *, service_scope AS scope, train_code || train_date AS trip_id FROM readings)""" + METRICS_CTE))(J.collect_metrics)


# ---------------------------------------------------------------------------
# Bundles and summary shapes
# ---------------------------------------------------------------------------

from railpulse.plans import overview as OV  # noqa: E402


def _overview(code):
    def run(spark, d):
        return OV.overview_document(OV.overview(OV.materialised(_a(spark, d)), WHOLE, code))
    return run


def _overview_rows(code):
    def run(spark, d):
        return OV.overview_rows(OV.overview(OV.materialised(_a(spark, d)), WHOLE, code))
    return run


def _part_sql(section: str, sql: str) -> str:
    """An ordered statement's cells in long form."""
    return f"""
SELECT '{section}' AS section, ordinal, field, value
FROM (SELECT row_number() OVER () AS ordinal, COLUMNS(*)::VARCHAR FROM ({sql}))
     UNPIVOT INCLUDE NULLS (value FOR field IN (COLUMNS(* EXCLUDE (ordinal))))"""


def _bundle_sql(scopes, rank_limit: int | None = None, with_routes: bool = True) -> str:
    where = f"{WIN} AND late_minutes <= 500 AND {O.scope_pred(scopes)}"
    categories, dashboard = _categories_sql(scopes), _dashboard_sql(scopes)
    parts = {
        "dashboard": dashboard, "stationRank": _ranking_sql(scopes, rank_limit), "hourly": _hourly_sql("resolved", where),
        "top10Delays": _top10_sql(where), "recentDelays": _recent5_sql(f"late_minutes <= 500 AND {O.scope_pred(scopes)}"),
        "destinations": _endpoint_sql(["destination"], where, "unknown", _DEST_ORDER, 10),
        "categories": f"SELECT category, trips FROM ({categories}) ORDER BY ordinal",
    }
    if with_routes:
        parts["routeRanking"] = _endpoint_sql(["origin", "destination"], where, "unknown", _ROUTE_ORDER, 15)
    parts["extras"] = f"""
SELECT max(trips) AS "maxCatCount", max(trips) FILTER (ordinal = 1) AS "catSmall", max(trips) FILTER (ordinal = 2) AS "catMedium",
       max(trips) FILTER (ordinal = 3) AS "catBig", max(trips) FILTER (ordinal = 4) AS "catExtreme",
       (SELECT on_time_trips FROM ({dashboard})) AS "catOnTime" FROM ({categories})"""
    return "\nUNION ALL".join(_part_sql(k, v) for k, v in parts.items())


register("analytics_overview_rows", _bundle_sql(SCOPES.values))(_overview_rows(None))
register("analytics_overview_scope_rows", _bundle_sql(SCOPE_H.values))(_overview_rows("HSTON"))


register("analytics_overview", None)(_overview(None))
register("analytics_overview_scope", None)(_overview("HSTON"))

register("analytics_summary", O.ab(f""",
s AS (SELECT * FROM snapshot WHERE {WIN} AND late_minutes <= 500),
t AS (SELECT COUNT(*) AS total_records,
             CAST(COALESCE(SUM(CASE WHEN late_minutes >= 5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS total_delays,
             {O.round1('COALESCE(AVG(CASE WHEN late_minutes >= 5 THEN CAST(late_minutes AS DOUBLE) END), 0)')} AS avg_delay_minutes,
             CAST(COALESCE(SUM(CASE WHEN late_minutes BETWEEN 0 AND 4 THEN 1 ELSE 0 END), 0) AS BIGINT) AS on_time,
             CAST(COALESCE(SUM(CASE WHEN late_minutes BETWEEN 5 AND 9 THEN 1 ELSE 0 END), 0) AS BIGINT) AS small,
             CAST(COALESCE(SUM(CASE WHEN late_minutes BETWEEN 10 AND 19 THEN 1 ELSE 0 END), 0) AS BIGINT) AS medium,
             CAST(COALESCE(SUM(CASE WHEN late_minutes BETWEEN 20 AND 39 THEN 1 ELSE 0 END), 0) AS BIGINT) AS big,
             CAST(COALESCE(SUM(CASE WHEN late_minutes >= 40 OR late_minutes < 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS extreme
      FROM s),
ws AS (SELECT station_code AS most_delayed_station FROM s WHERE late_minutes >= 5
       GROUP BY station_code ORDER BY COUNT(*) DESC, station_code LIMIT 1),
wt AS (SELECT t2.train_code AS most_delayed_train FROM s JOIN trip t2 ON t2.trip_id = s.trip_id
       WHERE s.late_minutes >= 5 GROUP BY t2.train_code ORDER BY COUNT(*) DESC, t2.train_code LIMIT 1)
SELECT t.*, (SELECT most_delayed_station FROM ws) AS most_delayed_station,
       (SELECT most_delayed_train FROM wt) AS most_delayed_train FROM t"""))(
    lambda spark, d: OV.analytics_summary(_a(spark, d), WHOLE))

register("station_delay_summary", O.a(f"""
SELECT station_code, MAX(station_full_name) AS station_name, COUNT(*) AS delay_count,
       {O.round1('AVG(CAST(late_minutes AS DOUBLE))')} AS avg_delay_minutes,
       MAX(late_minutes) AS max_delay_minutes
FROM snapshot WHERE {WIN} AND late_minutes <= 500 AND late_minutes >= 5 GROUP BY station_code"""))(
    lambda spark, d: OV.station_delay_summary(_a(spark, d), WHOLE))


def _station_parts(spark, d):
    data = OV.materialised(_a(spark, d))
    return OV.station_page(data, P.live_payloads(spark, d, newest=True, trips=data.trips()), "CNLLY", WHOLE)


def _station_page(spark, d):
    parts = _station_parts(spark, d)
    doc = OV.overview_document({k: v for k, v in parts.items() if k not in ("board", "boardCounts")})
    board = parts["board"].select(F.struct("train_code", "station_code", "late_minutes", "due_in",
                                           "origin", "destination").alias("r")) \
        .agg(F.array_sort(F.collect_list("r")).alias("board"), F.lit(1).alias("_k"))
    counts = parts["boardCounts"].select(F.col("trains").alias("board_trains"),
                                         F.col("late_trains").alias("board_late"),
                                         F.col("on_time_trains").alias("board_on_time"), F.lit(1).alias("_k"))
    name = C.selected_station_name(C.tracked_stations(_catalog(spark, d)), "cnlly") \
        .withColumn("_k", F.lit(1))
    return doc.withColumn("_k", F.lit(1)).join(board, "_k").join(counts, "_k", "left").join(name, "_k").drop("_k")


register("station_page", None)(_station_page)
BOARD_FIELDS = ("train_code", "station_code", "late_minutes", "due_in", "origin", "destination")


def _station_page_rows(spark, d):
    parts = _station_parts(spark, d)
    parts["board"] = parts["board"].select(*BOARD_FIELDS)
    parts["name"] = C.selected_station_name(C.tracked_stations(_catalog(spark, d)), "cnlly")
    return OV.overview_rows(parts)


SELECTED_NAME_SQL = _stn("""
SELECT COALESCE((SELECT MIN(station_desc) FROM allst WHERE code IN ('CNLLY', 'HSTON') AND UPPER(station_code) = 'CNLLY'), 'cnlly') AS station_name""")
register("station_page_rows", "\nUNION ALL".join([
    _bundle_sql(SCOPES.values, rank_limit=15, with_routes=False),
    _part_sql("board", _lv(_LATEST + f"""
SELECT {", ".join(BOARD_FIELDS)} FROM board WHERE board_station = 'CNLLY'
ORDER BY train_code NULLS FIRST, station_code NULLS FIRST, late_minutes, due_in, origin NULLS FIRST, destination NULLS FIRST""")),
    _part_sql("boardCounts", _lv(_LATEST + """
SELECT board_station, count(*) AS trains, count(*) FILTER (late_minutes >= 5) AS late_trains, count(*) FILTER (late_minutes < 5) AS on_time_trains
FROM board WHERE board_station = 'CNLLY' GROUP BY board_station""")),
    _part_sql("name", SELECTED_NAME_SQL)]))(_station_page_rows)
register("selected_station_name", SELECTED_NAME_SQL)(
    lambda spark, d: C.selected_station_name(C.tracked_stations(_catalog(spark, d)), "cnlly"))


# ---------------------------------------------------------------------------
# O-S5 snapshot append, batch form of the collector: route -> change filter ->
# snapshot rows with their service_date partition
# ---------------------------------------------------------------------------

APPEND_FIELDS = ("train_code", "station_full_name", "station_code", "train_date", "origin", "destination", "late_minutes",
                 "sch_depart", "train_type")


def _snapshot_append(spark, d):
    routed = LV.route_live_rows(_live_rows(spark, d, APPEND_FIELDS), _catalog(spark, d)) \
        .select("service_scope", "station_code", "station_full_name", "sch_depart", "late_minutes", "captured_at", "train_code",
                "train_date", F.col("position").cast("long").alias("poll_id"))
    changed = D.state_changes(routed)
    return changed.select("service_scope", "station_code", "station_full_name", "sch_depart", "late_minutes",
                          "captured_at", "train_code", "train_date",
                          F.to_date("captured_at").alias("service_date"))


register("snapshot_append", O.with_views(f""",
routed AS (
  SELECT lv.*, r.service_scope,
         ROW_NUMBER() OVER (PARTITION BY lv.board_station, lv.captured_at
                            ORDER BY lv.trip_id, lv.sch_depart, lv.late_minutes) AS pos
  FROM lv JOIN roles r ON r.code = UPPER(TRIM(COALESCE(lv.board_station, '')))
  WHERE LOWER(COALESCE(lv.train_type, '')) <> 'bus'
    AND CASE WHEN r.service_scope = 'HEUSTON' THEN {HEU} OR r.code = 'HSTON' ELSE NOT {HEU} END),
x AS (SELECT *, LAG(late_minutes) OVER (PARTITION BY service_scope, train_code, station_code, train_date, sch_depart,
                                                     CAST(captured_at - INTERVAL 3 HOUR AS DATE)
                                        ORDER BY captured_at, pos) AS prev
      FROM routed)
SELECT service_scope, station_code, station_full_name, sch_depart, late_minutes, captured_at, train_code, train_date,
       CAST(captured_at AS DATE) AS service_date
FROM x WHERE prev IS DISTINCT FROM late_minutes""", O.TRIP_VIEW, O.SNAPSHOT_VIEW, LIVE_VIEW, STN_VIEW))(_snapshot_append)


# Legacy single-station variants (hourly, largest delays, destinations).
_LW = f"{WIN} AND {_sp(STATION)}"
register("legacy_hourly_station", _rec(f"""
SELECT CAST(EXTRACT(hour FROM captured_at) AS INTEGER) AS hour,
       printf('%02d:00', CAST(EXTRACT(hour FROM captured_at) AS INTEGER)) AS hour_label,
       COUNT(*) AS total,
       CAST(SUM(CASE WHEN late_minutes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS delayed,
       {O.round1('COALESCE(AVG(CASE WHEN late_minutes > 0 THEN CAST(late_minutes AS DOUBLE) END), 0)')} AS avg_delay,
       {O.prob('SUM(CASE WHEN late_minutes > 0 THEN 1 ELSE 0 END)', 'COUNT(*)')} AS delay_probability
FROM rec WHERE {_LW} GROUP BY 1 ORDER BY 1"""))(lambda spark, d: L.hourly(_a(spark, d), WHOLE, filt=STATION))
register("legacy_top10_station", _rec(f"""
SELECT train_code, station_full_name, train_date, sch_depart, sch_arrival, direction, origin, destination,
       CAST(MAX(late_minutes) AS INTEGER) AS peak_delay, COUNT(*) AS snapshot_count
FROM rec WHERE {_LW}
GROUP BY train_code, station_full_name, train_date, sch_depart, sch_arrival, direction, origin, destination
HAVING MAX(late_minutes) >= 5
ORDER BY peak_delay DESC, train_code ASC NULLS FIRST, station_full_name ASC NULLS FIRST,
         train_date ASC NULLS FIRST, sch_depart ASC NULLS FIRST, sch_arrival ASC NULLS FIRST,
         direction ASC NULLS FIRST, origin ASC NULLS FIRST, destination ASC NULLS FIRST
LIMIT 10"""))(lambda spark, d: L.top10(_a(spark, d), WHOLE, filt=STATION))
register("legacy_destinations_station", _rec(f""",
g AS (SELECT destination, {LKEY}, MAX(late_minutes) AS peak FROM rec
      WHERE destination IS NOT NULL AND destination <> '' AND {_LW}
      GROUP BY destination, {LKEY}),
r AS (SELECT destination, COUNT(*) AS total_trips,
             CAST(SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS delayed_trips,
             SUM(CASE WHEN peak >= 5 THEN peak ELSE 0 END) AS tot
      FROM g GROUP BY destination HAVING SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END) > 0)
SELECT destination, total_trips, delayed_trips, {O.round1(O.ratio('tot', 'delayed_trips'))} AS average_delay,
       {O.prob('delayed_trips', 'total_trips')} AS delay_probability
FROM r ORDER BY {O.ratio('tot', 'delayed_trips')} DESC, destination LIMIT 10"""))(
    lambda spark, d: L.destinations(_a(spark, d), WHOLE, filt=STATION))
