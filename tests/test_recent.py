"""The newest readings are found from the newest end of a long history."""

import uuid

import pytest

from railpulse.functions.scope import ScopeFilter
from railpulse.operators import legacy as L
from railpulse.operators import reports as R
from railpulse.session import checkpoint_root
from railpulse.sources.tables import FrameData, ParquetStore

DAYS = 400


@pytest.fixture(scope="module")
def store(spark):
    s = ParquetStore(spark, f"{checkpoint_root(spark)}/test-recent-{uuid.uuid4().hex}")
    spark.range(DAYS * 3).selectExpr(
        "id % 90 as trip_id", "concat('S', id % 3) as station_code", "'Station' as station_full_name", "'CONNOLLY' as service_scope",
        "'10:00' as sch_depart", "'09:59' as sch_arrival", "'10:00' as exp_depart", "'09:59' as exp_arrival", "'' as status",
        "case when id % 3 = 2 and id > 30 then 2 else 6 end as late_minutes",
        "timestamp_ntz'2024-01-01 08:00:00' + make_dt_interval(cast(id div 3 as int), cast(id % 3 as int)) as captured_at",
        "cast('2024-01-01' as date) + cast(id div 3 as int) as service_date").repartition(1).write.partitionBy("service_date").parquet(s.snapshots_path)
    spark.range(90).selectExpr("id as trip_id", "concat('T', id) as train_code", "'d' as train_date", "'DART' as train_type", "'a' as origin",
                               "'b' as destination", "'N' as direction").write.parquet(s.trips_path)
    s.latest()
    return s


@pytest.fixture
def days_read(store, monkeypatch):
    """Folders of days that each read names."""
    out = []
    real = ParquetStore.read_folders
    monkeypatch.setattr(ParquetStore, "read_folders", lambda self, t, names, schema: out.append((t, len(names))) or real(self, t, names, schema))
    return lambda: max(n for t, n in out if t == "snapshots")


def whole(report, store, monkeypatch):
    """The same report over the whole history, read as one folder."""
    with monkeypatch.context() as m:
        m.setattr(R, "newest_window", lambda *a: None)
        m.setattr(L, "newest_window", lambda *a: None)
        return report(FrameData(store.spark, store.spark.read.parquet(store.snapshots_path), store.trips())).collect()


@pytest.mark.parametrize("report", [
    lambda s: R.recent_delayed_trips(s, keep_captured_at=True), lambda s: R.recent_delay_rows(s), lambda s: L.recent_rows(s),
    lambda s: R.recent_delayed_trips(s, ScopeFilter.station("S1"), keep_captured_at=True)])
def test_only_the_newest_days_are_read(store, days_read, monkeypatch, report):
    got = report(store).collect()
    assert days_read() <= 64
    assert got == whole(report, store, monkeypatch) and len(got) in (5, 50)


def test_a_rare_candidate_is_found_in_the_oldest_days(store, monkeypatch):
    rare = lambda s: R.recent_delayed_trips(s, ScopeFilter.station("S2"), keep_captured_at=True)
    got = rare(store).collect()
    assert got == whole(rare, store, monkeypatch) and len(got) == 5 and got[0].captured_at.year == 2024


def test_a_large_limit_is_not_broadcast(store):
    plan = R.recent_delay_rows(store, limit=R.BROADCAST_LIMIT + 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
    assert "strategy=broadcast" in R.recent_delay_rows(store)._jdf.queryExecution().optimizedPlan().toString()
