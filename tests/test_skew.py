"""One trip holding a third of all snapshots: results stay exact and the
snapshot side is partially aggregated before any shuffle."""

import duckdb
from pyspark.sql import functions as F

from railpulse.functions.scope import ScopeFilter
from railpulse.operators import reports as R
from railpulse.plans.registry import WHOLE
from railpulse.sources.bindings import TpchBinding
from railpulse.sources.tables import FrameData

from .conftest import SMALL


def _skewed(spark):
    a = TpchBinding(spark, SMALL)
    trips = a.trips()
    hot = trips.agg(F.min("trip_id")).first()[0]
    snaps = a.snapshots().withColumn(
        "trip_id", F.when(F.pmod(F.xxhash64("station_code", "sch_depart", "captured_at"), F.lit(3)) == 0,
                          F.lit(hot)).otherwise(F.col("trip_id")))
    return FrameData(spark, snaps, trips), hot


def test_skewed_trip(spark):
    data, hot = _skewed(spark)
    s = data.snapshots().toPandas()
    t = data.trips().toPandas()
    assert (s["trip_id"] == hot).mean() > 0.25
    con = duckdb.connect()
    con.register("s", s)
    con.register("t", t)
    want = con.execute("""
        WITH r AS (SELECT s.*, COALESCE(s.service_scope, CASE WHEN UPPER(s.station_code) = 'HSTON'
                     OR LOWER(COALESCE(t.origin, '')) LIKE '%heuston%'
                     OR LOWER(COALESCE(t.destination, '')) LIKE '%heuston%' THEN 'HEUSTON' ELSE 'CONNOLLY' END) AS sc
                   FROM s JOIN t USING (trip_id) WHERE late_minutes <= 500),
             p AS (SELECT trip_id, COUNT(*) AS n, MAX(late_minutes) AS peak FROM r
                   WHERE sc IN ('CONNOLLY', 'HEUSTON') GROUP BY trip_id)
        SELECT SUM(n), COUNT(*), SUM(CASE WHEN peak >= 5 THEN 1 ELSE 0 END), MAX(peak) FROM p""").fetchone()
    d = R.dashboard(data, WHOLE, ScopeFilter.scopes()).first()
    assert (d.total_snapshots, d.unique_trips, d.delayed_trips, d.max_delay) == tuple(int(x) for x in want)
    top = R.top_delayed_trips(data, WHOLE, ScopeFilter.scopes()).collect()
    assert len(top) == 10 and top[0].peak_delay == want[3]


def test_partial_aggregation_before_shuffle(spark):
    data, _ = _skewed(spark)
    plan = R.dashboard(data, WHOLE, ScopeFilter.scopes())._jdf.queryExecution().executedPlan().toString()
    # The first operator above the snapshot scan side is a partial hash aggregate.
    assert "partial_count" in plan and "partial_max" in plan
    assert "SortAggregate" not in plan
