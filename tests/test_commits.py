"""The store under several writers: streams, refreshes and maintenance beside each other and beside readers."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from railpulse.functions.constants import CONNOLLY
from railpulse.operators import metrics as M
from railpulse.operators import metrics_table as MT
from railpulse.session import checkpoint_root
from railpulse.sources import folders
from railpulse.sources.commits import CommitLog, Conflict, Version
from railpulse.sources.tables import ParquetStore
from railpulse.streaming import maintenance
from railpulse.streaming.collect import start_collect, write_batch
from railpulse.streaming.maintenance import maintain

from .test_stream import _land

NOW = dt.datetime(2025, 1, 20)


@pytest.fixture
def root(spark):
    return f"{checkpoint_root(spark)}/test-commits-{uuid.uuid4().hex}"


@pytest.fixture
def store(spark, root):
    return ParquetStore(spark, f"{root}/store")


def batch(spark, *rows):
    """A collector's batch of (captured_at, train, station, late[, destination])."""
    rows = [(dt.datetime.fromisoformat(r[0]), *r[1:4], r[4] if len(r) > 4 else "Howth", i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "captured_at timestamp_ntz, train_code string, station_code string, late_minutes int, destination string, _seq int")
    return df.selectExpr("*", "'1 Jan 2025' as train_date", "'DART' as train_type", "'Bray' as origin", "'N' as direction", "'CONNOLLY' as service_scope",
                         "concat('Station ', station_code) as station_full_name", "'10:00' as sch_depart", "'09:59' as sch_arrival",
                         "'10:05' as exp_depart", "'10:04' as exp_arrival", "'En Route' as status")


def stored(store):
    """(train, station, late, captured at) of all readings through their trips."""
    rows = store.snapshots().join(store.trips(), "trip_id").collect()
    assert len(rows) == store.snapshots().count() and store.trips().count() == store.trips().select("trip_id").distinct().count()
    return sorted((r.train_code, r.station_code, r.late_minutes, r.captured_at.isoformat(" ", "minutes")) for r in rows)


def same_rows(a, b):
    a, b = a.select(*M.METRIC_COLUMNS), b.select(*M.METRIC_COLUMNS)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def is_view(store):
    """The metrics are those of the snapshots."""
    return same_rows(store.metrics(), M.build_daily_metrics(store, with_updated_at=False))


def test_two_starts_keep_all_and_a_replay_changes_nothing(spark, root, store):
    for i, train in enumerate(("T1", "T2")):
        _land(spark, f"{root}/{i}", "2025-01-01 12:00:00", "S", train, 5)
        start_collect(spark, f"{root}/{i}/landing", store.root, f"{root}/ckpt-{i}", scope=CONNOLLY, trigger={"availableNow": True}).awaitTermination()
    assert [r[0] for r in stored(store)] == ["T1", "T2"] and is_view(store)
    before = store.latest()
    run = next(iter(before.runs))
    write_batch(store, batch(spark, ("2025-01-01 12:00", "T9", "S", 9)), 0, run)
    assert store.latest() == before
    row = store.snapshots().where("late_minutes = 5").first()
    assert row.trip_id is not None and {"exp_depart", "exp_arrival", "status"} <= set(row.asDict())


def test_another_stream_over_the_same_documents_adds_nothing(spark, root, store):
    for at in ("2025-01-01 12:00:00", "2025-01-01 12:30:00"):
        _land(spark, root, at, "S", "T", 5 if at.endswith("12:00:00") else 7)
    for i in range(2):
        start_collect(spark, f"{root}/landing", store.root, f"{root}/ckpt-{i}", scope=CONNOLLY, trigger={"availableNow": True}).awaitTermination()
        assert [r[2] for r in stored(store)] == [5, 7] and is_view(store)


def test_restart_without_a_checkpoint_of_its_own_goes_on(spark, root, store):
    for at, late, want in (("12:00", 5, [5]), ("12:10", 5, [5]), ("12:20", 6, [5, 6])):
        _land(spark, root, f"2025-01-01 {at}:00", "S", "T", late)
        start_collect(spark, f"{root}/landing", store.root, scope=CONNOLLY, trigger={"availableNow": True}).awaitTermination()
        assert [r[2] for r in stored(store)] == want
    assert len(store.latest().runs) == 1


def test_a_failed_batch_leaves_nothing_and_is_written_again(spark, store, monkeypatch):
    write_batch(store, batch(spark, ("2025-01-01 12:00", "A", "S", 5)), 0, "run")
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write_batch(store, batch(spark, ("2025-01-01 12:01", "A", "S", 8), ("2025-01-01 12:01", "B", "S", 8)), 1, "run")
    assert len(stored(store)) == 1 and is_view(store)
    write_batch(store, batch(spark, ("2025-01-01 12:01", "A", "S", 8), ("2025-01-01 12:01", "B", "S", 8)), 1, "run")
    assert len(stored(store)) == 3 and is_view(store)


def test_maintenance_between_the_writes_of_a_batch(spark, store, monkeypatch):
    write_batch(store, batch(spark, ("2024-01-01 12:00", "OLD", "S", 5), ("2025-01-01 12:00", "A", "S", 5)), 0, "run")
    real, calls = MT.merge_batch, []

    def meanwhile(*a, **k):
        if not calls:  # trips and snapshots of the batch are written, nothing is committed
            calls.append(1)
            maintain(store, NOW)
        return real(*a, **k)
    monkeypatch.setattr(MT, "merge_batch", meanwhile)
    # the trip OLD has lost its last snapshot to the retention, and the batch names it again
    write_batch(store, batch(spark, ("2025-01-02 12:00", "OLD", "S", 6), ("2025-01-02 12:00", "NEW", "S", 6)), 1, "run")
    assert [r[0] for r in stored(store)] == ["A", "NEW", "OLD"] and is_view(store)
    maintain(store, NOW)
    assert [r[0] for r in stored(store)] == ["A", "NEW", "OLD"]


def test_a_batch_in_the_midst_of_maintenance(spark, store, monkeypatch):
    write_batch(store, batch(spark, ("2024-01-01 12:00", "OLD", "S", 5), ("2025-01-01 12:00", "A", "S", 5)), 0, "run")
    real, calls = maintenance.D.live_trips, []

    def meanwhile(*a, **k):
        out = real(*a, **k)
        if not calls:  # the trips that stay are settled, OLD is not among them
            calls.append(1)
            write_batch(store, batch(spark, ("2025-01-02 12:00", "OLD", "S", 6), ("2025-01-02 12:00", "NEW", "S", 6)), 1, "run")
        return out
    monkeypatch.setattr(maintenance.D, "live_trips", meanwhile)
    maintain(store, NOW, keep_retired=dt.timedelta(0))
    assert [r[0] for r in stored(store)] == ["A", "NEW", "OLD"] and is_view(store)


def test_maintenance_folds_and_is_idempotent(spark, store):
    for i in range(2):
        write_batch(store, batch(spark, (f"2025-01-01 12:0{i}", "A", "S", 5 + i), (f"2024-10-22 1{2 * i}:00", "C", "S", 5),
                                 (f"2024-10-22 1{2 * i + 1}:00", "C", "S", 5), ("2024-01-01 12:00", "GONE", "S", 5)), i, "run")
    stats = maintain(store, NOW.replace(hour=12), keep_retired=dt.timedelta(0))  # cutoff 2024-10-22 12:00
    assert stats["snapshot_days_dropped"] == stats["metric_days_dropped"] == 1 and stats["trips_dropped"] == 1
    v = store.latest()
    assert [len(v.of(t)) for t in ("trips", "snapshots", "metrics")] == [1, 2, 2] and not v.retired
    assert [r[3][-5:] for r in stored(store) if r[0] == "C"] == ["12:00", "13:00"]
    assert store.metrics().where("service_date = '2024-10-22'").first().total_snapshots == 4  # as computed before
    assert maintain(store, NOW.replace(hour=12), keep_retired=dt.timedelta(0))["days_compacted"] == 0 and store.latest() == v
    kept = {f"{t}/{f}" for t in v.tables for f in v.of(t)}
    there = {f"{t}/{f}" for t in v.tables for f in store._leaves(t)}
    assert there == kept


def test_metrics_after_any_split_equal_a_rebuild(spark, store, monkeypatch):
    monkeypatch.setattr(MT, "FOLD", 2)
    rng = random.Random(1)
    rows = [(f"2025-01-0{rng.randrange(1, 4)} {rng.randrange(7, 23):02}:{rng.randrange(60):02}", f"T{rng.randrange(12)}", rng.choice(["S", "s", "HSTON"]),
             rng.choice([-3, 0, 4, 5, 12, 25, 60, 700]), rng.choice(["Howth", "", "Dublin Heuston"])) for _ in range(120)]
    at = sorted(rng.sample(range(1, 120), 3))
    for i, (a, b) in enumerate(zip([0, *at], [*at, 120], strict=True)):
        write_batch(store, batch(spark, *rows[a:b]), i, "run")
        assert is_view(store)
    assert store.snapshots().count() == 120
    before = store.metrics().select(*M.METRIC_COLUMNS).collect()
    MT.rebuild_metrics(store)
    assert is_view(store) and sorted(map(str, before)) == sorted(map(str, store.metrics().select(*M.METRIC_COLUMNS).collect()))


def test_a_batch_reads_the_states_of_its_dates_only(spark, store, monkeypatch):
    for i, d in enumerate(("01", "02", "03")):
        write_batch(store, batch(spark, (f"2025-01-{d} 12:00", "A", "S", 5), (f"2025-01-{d} 12:00", "A", "R", 5)), i, "run")
    untouched = store.metrics().where("service_date = '2025-01-03' and station_code = 'R'").first().updated_at
    read = []
    real = ParquetStore.read_folders
    monkeypatch.setattr(ParquetStore, "read_folders", lambda self, t, names, schema: read.append((t, tuple(names))) or real(self, t, names, schema))
    write_batch(store, batch(spark, ("2025-01-03 13:00", "B", "S", 9)), 3, "run")
    assert all("2025-01-03" in n for t, names in read if t in ("states", "metrics", "snapshots") for n in names)
    assert store.metrics().where("service_date = '2025-01-03' and station_code = 'R'").first().updated_at == untouched
    assert is_view(store)


def test_a_reader_sees_the_table_before_or_after_a_swap(spark, store):
    write_batch(store, batch(spark, ("2025-01-01 12:00", "A", "S", 5)), 0, "run")
    old = store.metrics()  # read lazily
    pinned = store.at(store.latest())
    write_batch(store, batch(spark, ("2025-01-01 12:01", "A", "S", 50)), 1, "run")
    MT.refresh_dates(store, ["2025-01-01"])
    maintain(store, NOW)
    assert [r.max_delay_minutes for r in old.collect()] == [r.max_delay_minutes for r in pinned.metrics().collect()] == [5]
    assert [r.max_delay_minutes for r in store.metrics().collect()] == [50]
    # half-written files and temporary names are not versions
    folders.write_text(spark, f"{store.root}/_commits/.half", "{")
    assert store.metrics().count() == 1


def test_refresh_beside_a_collector(spark, store, monkeypatch):
    write_batch(store, batch(spark, ("2025-01-01 12:00", "A", "S", 5), ("2025-01-02 12:00", "A", "S", 5)), 0, "run")
    real, calls = MT.metrics_from_states, []

    def meanwhile(*a, **k):
        if not calls:
            calls.append(1)
            write_batch(store, batch(spark, ("2025-01-02 13:00", "B", "S", 9)), 1, "run")
        return real(*a, **k)
    monkeypatch.setattr(MT, "metrics_from_states", meanwhile)
    MT.rebuild_metrics(store)
    assert is_view(store) and store.metrics().agg(F.sum("total_snapshots")).first()[0] == 3


def test_a_date_without_snapshots_loses_its_metrics(spark, store):
    write_batch(store, batch(spark, ("2025-01-01 12:00", "A", "S", 5), ("2025-01-02 12:00", "A", "S", 5)), 0, "run")
    v = store.latest()
    store.log.commit(v, {}, {"snapshots": v.of("snapshots", "service_date=2025-01-02/")})
    MT.refresh_dates(store, ["2025-01-02", "2025-01-03"])
    assert [r.service_date.day for r in store.metrics().collect()] == [1] and is_view(store)


def test_a_plain_store_is_taken_over(spark, store):
    df = batch(spark, ("2025-01-01 12:00", "A", "S", 5), ("2024-01-01 12:00", "B", "S", 5))
    df.selectExpr("xxhash64(train_code) as trip_id", "station_code", "station_full_name", "service_scope", "sch_depart", "sch_arrival", "exp_depart",
                  "exp_arrival", "status", "late_minutes", "captured_at", "to_date(captured_at) as service_date").write.parquet(store.snapshots_path)
    df.selectExpr("xxhash64(train_code) as trip_id", "train_code", "train_date", "train_type", "origin", "destination", "direction").write.parquet(store.trips_path)
    assert len(stored(store)) == 2
    MT.rebuild_metrics(store)
    assert is_view(store) and store.metrics().count() == 2
    write_batch(store, batch(spark, ("2025-01-01 13:00", "C", "S", 5)), 0, "run")
    assert len(stored(store)) == 3 and is_view(store)
    maintain(store, NOW, keep_retired=dt.timedelta(0))
    assert [r[0] for r in stored(store)] == ["A", "C"]


def test_commits_on_a_newer_version(spark, root):
    log = CommitLog(spark, root)
    first = log.commit(Version(), {"t": ["a", "b"], "u": ["d=1/x"]})
    log.commit(first, {"t": ["c"]}, {"u": ["d=1/x"]}, run=("r", 3))
    assert log.commit(first, {"t": ["e"]}).tables["t"] == ("a", "b", "c", "e")
    with pytest.raises(Conflict):
        log.commit(first, {}, {"u": ["d=1/x"]})
    with pytest.raises(Conflict):
        log.commit(first, {"t": ["f"]}, same=[("u", "d=1/")])
    with pytest.raises(Conflict):
        log.commit(first, {"t": ["f"]}, valid=lambda newest: "e" not in newest.of("t"))
    assert log.commit(first, {"t": ["f"]}, same=[("u", "d=2/")]).runs == {"r": 3}
    taken = Version(log.latest().number, {"t": ("x",)})
    assert not log.create(taken) and log.latest().of("t") == ("a", "b", "c", "e", "f")
    log.prune(1)
    assert len(folders.children(spark, log.path, "0")) == 1 and log.latest().number == 3


def test_a_batch_of_many_tasks_leaves_few_files(spark, store):
    rows = [(f"2025-01-0{1 + i % 3} 12:{i // 3:02d}", f"T{i}", "S", 5) for i in range(90)]
    write_batch(store, batch(spark, *rows).repartition(30), 0, "run")
    v = store.latest()
    for table in ("snapshots", "states", "metrics"):
        assert len(v.of(table)) == 3
        assert all(len(folders.files(spark, f"{store.path(table)}/{n}")) <= 2 for n in v.of(table))
    assert len(stored(store)) == 90 and is_view(store)
    assert folders.children(spark, f"{store.root}/_batches", "") == []
