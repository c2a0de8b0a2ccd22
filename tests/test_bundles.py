"""Bundles read the history once and keep both rules of an open end."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from railpulse.operators import metrics as M
from railpulse.plans import overview as OV
from railpulse.plans import registry
from railpulse.sources import payloads as P
from railpulse.sources import tables
from railpulse.sources.bindings import TpchBinding
from railpulse.sources.tables import FrameData

from .conftest import SMALL


def test_a_bundle_scans_snapshots_once(spark, monkeypatch):
    read = []
    real = TpchBinding.table
    monkeypatch.setattr(TpchBinding, "table", lambda self, name: read.append(name) or real(self, name))
    df = registry.queries()["analytics_overview_rows"](spark, SMALL)
    assert df.count() > 100
    assert read.count("lineitem") == read.count("orders") == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_both_open_ends(spark, golden):
    windows = OV.windows("all", as_of=dt.datetime(2025, 5, 12, 0, 7))
    assert windows["window"].end == dt.datetime(2025, 5, 13, 0, 7) and windows["aggregate_window"].end == dt.datetime(2025, 5, 13)
    parts = OV.overview(OV.materialised(golden), **windows)
    hourly = sum(r.total for r in parts["hourly"].collect())
    assert hourly == parts["dashboard"].first().total_snapshots + 1 == 9
    rows = {(r.section, r.ordinal, r.field): r.value for r in OV.overview_rows(parts).collect()}
    assert rows["dashboard", 1, "total_snapshots"] == "8" and rows["hourly", 1, "hour"] == "0"
    assert rows["extras", 1, "catOnTime"] == rows["dashboard", 1, "on_time_trips"]
    assert rows["extras", 1, "maxCatCount"] == str(max(int(rows["categories", i, "trips"]) for i in range(1, 5)))
    assert rows["categories", 4, "trips"] == rows["extras", 1, "catExtreme"]


def test_a_bundle_writes_only_what_its_parts_read(golden):
    data = OV.materialised(golden)
    assert set(data.snapshots().columns) == {*OV.SNAPSHOT_PARTS, "resolved_scope"}


def odd(spark, golden):
    """The golden rows, a trip that comes twice with other endpoints, and stations without a code or a name."""
    trips, snaps = golden.trips(), golden.snapshots()
    other = trips.where("trip_id = 2").withColumns({"origin": F.lit("Dublin Heuston"), "destination": F.lit(None).cast("string")})
    odd = snaps.where("id in (1, 7)").withColumn("station_full_name", F.lit(None).cast("string")).unionByName(
        snaps.where("id in (2, 5)").withColumn("station_code", F.lit(None).cast("string"))).unionByName(
        snaps.where("id = 3").withColumn("station_full_name", F.lit("Tara")))
    return FrameData(spark, snaps.unionByName(odd), trips.unionByName(other))


@pytest.mark.parametrize("limit", [None, 1])
def test_a_bundles_metrics_do_not_shuffle_by_name(spark, golden, monkeypatch, limit):
    if limit is not None:  # more names than may be broadcast
        monkeypatch.setattr(tables, "BROADCAST_LIMIT", limit)
    data = OV.materialised(odd(spark, golden))
    metrics = M.build_daily_metrics(data, with_updated_at=False, names=data.names)
    want = M.build_daily_metrics(FrameData(spark, data.snapshots(), data.trips()), with_updated_at=False)
    assert sorted(map(str, metrics.collect())) == sorted(map(str, want.collect()))
    plan = OV.overview(data, registry.WHOLE)["stationRank"]._jdf.queryExecution().executedPlan().toString()
    by = [re.sub(r"#\d+L?", "", x).split(", ")[:-1] for x in re.findall(r"Exchange hashpartitioning\((.*?)\)", plan)]
    if limit is None:
        # states, their join with the trips, metrics rows and stations; the counts per trip need no exchange of their own
        assert sorted(by) == [["service_date", "service_scope", "station_code", "origin", "destination"], ["station_code"], ["trip_id"],
                              ["trip_id"], ["trip_id", "service_date", "service_scope", "station_code", "station_full_name"]]
    else:
        assert ["station_full_name"] in by


@pytest.mark.parametrize("limit", [None, 1])
def test_the_station_page_reads_the_history_once_for_its_board(spark, monkeypatch, limit):
    if limit is not None:  # more stations than may be broadcast
        monkeypatch.setattr(tables, "BROADCAST_LIMIT", limit)
    trips = TpchBinding(spark, SMALL).trips().checkpoint()
    docs = P.live_payloads(spark, SMALL, newest=True, trips=trips)
    assert "FileScan" not in docs._jdf.queryExecution().executedPlan().toString()
    want = P.live_payloads(spark, SMALL, newest=True).collect()
    assert want and sorted(map(str, docs.collect())) == sorted(map(str, want))


def test_the_newest_rows_are_not_shuffled(spark, monkeypatch):
    seen = []
    real = P._live_columns
    monkeypatch.setattr(P, "_live_columns", lambda j: seen.append(j) or real(j))
    P.live_payloads(spark, SMALL, newest=True, trips=TpchBinding(spark, SMALL).trips().checkpoint())
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_a_bundle_looks_up_the_first_trips_only(spark, golden):
    data = OV.materialised(odd(spark, golden))
    assert data.trips_complete and not golden.trips_complete
    parts, plain = OV.overview(data, registry.WHOLE), OV.overview(FrameData(spark, data.snapshots(), data.trips()), registry.WHOLE)
    for name in ("top10Delays", "recentDelays"):
        plan = parts[name]._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(trip_id#\d+L, \d+\)", plan)) == 1  # the snapshots', not the trips'
        assert parts[name].collect() == plain[name].collect() != []


def test_snapshots_with_a_scope_may_lack_their_trip(spark, golden):
    """A store that keeps resolved scopes is not joined with the trips, so the lists of trips are."""
    snaps = golden.snapshots().withColumn("resolved_scope", F.lit("CONNOLLY"))
    data = OV.materialised(FrameData(spark, snaps, golden.trips().where("trip_id <> 3")))
    assert not data.trips_complete
    assert {r.train_code for r in OV.overview(data, registry.WHOLE)["top10Delays"].collect()} == {"E801", "P601"}
