"""DuckDB oracle SQL for the registered queries.

Each query is a WITH clause defining the canonical views over the
pre-registered test tables (same expressions as ``railpulse.sources.bindings``)
followed by the report body.  Ordering/NULL conventions are spelled out so the
oracle makes the same tie-break picks as Spark (ascending NULLS FIRST,
descending NULLS LAST).
"""

from __future__ import annotations

TRIP_VIEW = """
trip AS (
  SELECT o.o_orderkey AS trip_id,
         'E' || CAST(o.o_custkey % 500 AS VARCHAR) AS train_code,
         strftime(o.o_orderdate, '%Y-%m-%d') AS train_date,
         o.o_orderpriority AS train_type,
         CASE WHEN c.c_nationkey = 0 THEN ''
              WHEN c.c_nationkey = 1 THEN NULL
              WHEN c.c_nationkey = 2 THEN 'Dublin Heuston'
              ELSE n.n_name END AS origin,
         CASE WHEN o.o_orderkey % 25 = 3 THEN 'HEUSTON'
              WHEN o.o_orderkey % 25 = 4 THEN ''
              ELSE 'DEST_' || CAST(o.o_orderkey % 25 AS VARCHAR) END AS destination,
         CASE WHEN o.o_orderkey % 2 = 0 THEN 'Northbound' ELSE 'Southbound' END AS direction
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
)"""

SNAPSHOT_VIEW = """
snapshot AS (
  SELECT l_orderkey AS trip_id,
         CASE WHEN l_suppkey % 20 = 0 THEN 'HSTON'
              WHEN l_suppkey % 20 = 1 THEN 'CNLLY'
              WHEN l_suppkey % 20 = 2 THEN 'cnlly'
              ELSE 'ST' || CAST(l_suppkey % 20 AS VARCHAR) END AS station_code,
         'Station ' || CAST(l_suppkey % 20 AS VARCHAR) AS station_full_name,
         CASE WHEN l_returnflag = 'A' THEN 'CONNOLLY'
              WHEN l_returnflag = 'N' THEN 'HEUSTON' END AS service_scope,
         CAST(l_linenumber AS VARCHAR) AS sch_depart,
         CAST(NULL AS VARCHAR) AS sch_arrival,
         CAST(CASE WHEN l_partkey % 97 = 0 THEN 600
                   ELSE CAST(floor(l_quantity * l_discount * 12) AS INTEGER) - 4 END AS INTEGER) AS late_minutes,
         l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER))
                    + to_minutes(CAST(l_suppkey % 60 AS INTEGER)) AS captured_at
  FROM lineitem
)"""

# Snapshot joined to its trip with the resolved scope.
RESOLVED_VIEW = """
resolved AS (
  SELECT s.*, t.train_code, t.train_date, t.train_type, t.origin, t.destination, t.direction,
         COALESCE(s.service_scope,
                  CASE WHEN UPPER(s.station_code) = 'HSTON'
                         OR LOWER(COALESCE(t.origin, '')) LIKE '%heuston%'
                         OR LOWER(COALESCE(t.destination, '')) LIKE '%heuston%'
                       THEN 'HEUSTON' ELSE 'CONNOLLY' END) AS scope
  FROM snapshot s JOIN trip t ON t.trip_id = s.trip_id
)"""

POLL_VIEW = """
poll AS (
  SELECT event_id AS poll_id,
         'U' || CAST(user_id AS VARCHAR) AS train_code,
         UPPER(event_type) AS station_code,
         strftime(ts, '%Y-%m-%d') AS train_date,
         CAST(NULL AS VARCHAR) AS sch_depart,
         CAST(CAST(floor(value / 25) AS INTEGER) * 5 - 5 AS INTEGER) AS late_minutes,
         ts AS captured_at,
         CASE WHEN event_type = 'error' THEN 'Bus'
              WHEN event_type = 'signup' THEN NULL
              ELSE 'DART' END AS train_type,
         CASE WHEN user_id % 7 = 0 THEN 'Dublin Heuston' WHEN user_id % 7 = 1 THEN NULL
              ELSE 'Bray' END AS origin,
         CASE WHEN value >= 50 THEN 'Howth' ELSE 'Greystones' END AS destination,
         CASE WHEN event_id % 2 = 0 THEN 'Northbound' ELSE 'Southbound' END AS direction
  FROM events
)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",".join(views) + "\n" + body


def ab(body: str) -> str:
    """Binding A with the resolved join."""
    return with_views(body, TRIP_VIEW, SNAPSHOT_VIEW, RESOLVED_VIEW)


def a(body: str) -> str:
    return with_views(body, TRIP_VIEW, SNAPSHOT_VIEW)


def b(body: str) -> str:
    return with_views(body, POLL_VIEW)


def round1(x: str) -> str:
    return f"(floor(({x}) * 10.0 + 0.5) / 10.0)"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END)"


def prob(delayed: str, total: str) -> str:
    return f"(CASE WHEN ({total}) > 0 THEN {round1(f'CAST({delayed} AS DOUBLE) * 100.0 / ({total})')} ELSE 0.0 END)"


def band(delayed: str, total: str) -> str:
    p = prob(delayed, total)
    return f"(CASE WHEN {p} < 20 THEN 'low' WHEN {p} < 40 THEN 'medium' ELSE 'high' END)"


def win(lo: str, hi: str, col: str = "captured_at") -> str:
    return f"{col} >= TIMESTAMP '{lo}' AND {col} < TIMESTAMP '{hi}'"


def scope_pred(scopes) -> str:
    return "scope IN (" + ", ".join(f"'{s}'" for s in scopes) + ")"


def station_pred(kind: str, codes) -> str:
    if kind == "network":
        return "TRUE"
    return "UPPER(station_code) IN (" + ", ".join(f"'{c.upper()}'" for c in codes) + ")"
