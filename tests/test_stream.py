"""Streaming collector end to end: landed XML polls -> change filter ->
trips / snapshots / metrics in a Parquet store; stream = batch; idempotence."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from railpulse.functions.constants import CONNOLLY, HEUSTON
from railpulse.functions.scope import heuston_trip
from railpulse.operators import dataops as D
from railpulse.operators import metrics as M
from railpulse.operators import metrics_table as MT
from railpulse.operators.live import not_bus
from railpulse.session import checkpoint_root
from railpulse.sources.bindings import polls
from railpulse.sources import folders
from railpulse.sources.payloads import LIVE_ELEMENT, LIVE_FIELDS, LIVE_ROOT, _document, xml_element
from railpulse.sources.tables import ParquetStore
from railpulse.streaming.collect import land, start_change_stream, start_collect, start_rejects
from railpulse.streaming.jobs import poll_documents
from railpulse.streaming.maintenance import maintain

from .conftest import SMALL

KEY = ("train_code", "station_code", "train_date", "sch_depart")


def test_collect_stream(spark):
    root = f"{checkpoint_root(spark)}/test-collect-{uuid.uuid4().hex}"
    docs = poll_documents(spark, SMALL)
    cut = "2024-01-15 00:00:00"
    land(docs.where(F.col("polled_at") < F.lit(cut).cast("timestamp_ntz")).coalesce(1), f"{root}/landing")
    land(docs.where(F.col("polled_at") >= F.lit(cut).cast("timestamp_ntz")).coalesce(1), f"{root}/landing")
    q = start_collect(spark, f"{root}/landing", f"{root}/store", f"{root}/ckpt", scope=CONNOLLY,
                      trigger={"availableNow": True}, max_files=1)
    q.awaitTermination()
    assert q.exception() is None
    store = ParquetStore(spark, f"{root}/store")

    # Stream = batch: stored snapshots are exactly the batch change filter over the collected rows.
    collected = polls(spark, SMALL).where(D.in_service_hours() & not_bus() & ~heuston_trip())
    batch = D.state_changes(collected, key=KEY)
    got = store.snapshots().select("station_code", "late_minutes", "captured_at")
    want = batch.select("station_code", "late_minutes", "captured_at")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    # One trip per natural key, first write wins, ids derived from the key.
    trips = store.trips()
    fw = D.first_write_trips(collected.join(batch.select("poll_id"), "poll_id", "left_semi"))
    assert trips.count() == fw.count() == trips.select("trip_id").distinct().count()
    assert store.snapshots().join(trips, "trip_id", "left_anti").count() == 0

    # Metrics refreshed per batch equal a full rebuild over the store.
    cols = list(M.METRIC_COLUMNS)
    stored = store.metrics().select(*cols)
    rebuilt = M.build_daily_metrics(store, with_updated_at=False).select(*cols)
    assert stored.exceptAll(rebuilt).count() == 0 and rebuilt.exceptAll(stored).count() == 0

    # Refreshing a date twice changes nothing.
    day = stored.select(F.min("service_date")).first()[0]
    MT.refresh_dates(store, [day, day])
    again = store.metrics().select(*cols)
    assert again.exceptAll(rebuilt).count() == 0 and rebuilt.exceptAll(again).count() == 0

    # Maintenance: retention drops older days, keeps the cutoff day's later rows; idempotent.
    as_of = dt.datetime(2024, 4, 20, 12, 0)   # cutoff 2024-01-21 12:00
    maintain(store, as_of)
    cutoff = D.retention_cutoff(as_of)
    left = store.snapshots()
    assert left.where(F.col("captured_at") < F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")).count() == 0
    n1 = left.count()
    assert n1 == batch.where(F.col("captured_at") >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")).count()
    assert store.metrics().where(F.col("service_date") < F.lit(cutoff.date().isoformat()).cast("date")).count() == 0
    assert store.trips().join(store.snapshots(), "trip_id", "left_anti").count() == 0
    maintain(store, as_of, keep_retired=dt.timedelta(0))
    assert store.snapshots().count() == n1
    # Closed days are folded into one folder, and what was folded is gone.
    for day in folders.children(spark, store.snapshots_path, "service_date="):
        assert len(folders.children(spark, f"{store.snapshots_path}/{day}", "batch_id=")) <= 1


def test_live_board_stream(spark):
    """The streaming board equals the batch board over the same documents."""
    from railpulse.operators.live import live_board
    from railpulse.sources.payloads import live_payloads
    from railpulse.streaming.collect import read_live_board, start_live_board

    root = f"{checkpoint_root(spark)}/test-board-{uuid.uuid4().hex}"
    docs = live_payloads(spark, SMALL).withColumnRenamed("station_code", "board_station") \
        .withColumnRenamed("captured_at", "polled_at")
    cut = "1998-01-01 00:00:00"
    land(docs.where(F.col("polled_at") < F.lit(cut).cast("timestamp_ntz")).coalesce(1), f"{root}/landing")
    land(docs.where(F.col("polled_at") >= F.lit(cut).cast("timestamp_ntz")).coalesce(1), f"{root}/landing")
    q = start_live_board(spark, f"{root}/landing", f"{root}/board", f"{root}/ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    assert q.exception() is None
    cols = ["board_station", "train_code", "station_code", "late_minutes", "due_in"]
    got = read_live_board(spark, f"{root}/board").select(*cols)
    want = live_board(docs.withColumnRenamed("board_station", "station_code")
                      .withColumnRenamed("polled_at", "captured_at")).select(*cols)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _land(spark, root, polled_at, station, train, late, **fields):
    """Land one document of one row."""
    row = {"train_code": train, "station_code": station, "train_date": "1 Jan 2025", "late_minutes": late,
           "sch_depart": "10:00", "train_type": "DART", "origin": "Bray", "destination": "Howth"} | fields
    elem = xml_element(LIVE_ELEMENT, [(xml, F.lit(row.get(name)).cast("string")) for xml, name, _ in LIVE_FIELDS])
    land(spark.range(1).select(F.lit(station).alias("board_station"), F.lit(polled_at).cast("timestamp_ntz").alias("polled_at"),
                               _document(F.array(elem), LIVE_ROOT).alias("payload")), f"{root}/landing")


def _changes(spark, root):
    start_change_stream(spark, f"{root}/landing", f"{root}/out", f"{root}/ckpt", scope=CONNOLLY).awaitTermination()
    return sorted((r.station_code, r.train_code, r.late_minutes, r.captured_at.strftime("%d %H:%M"))
                  for r in spark.read.parquet(f"{root}/out").collect())


def test_late_documents_are_kept(spark):
    root = f"{checkpoint_root(spark)}/test-late-{uuid.uuid4().hex}"
    for hour, late in ((10, 1), (14, 1), (15, 2)):
        _land(spark, root, f"2025-01-01 {hour}:00:00", "S", "T", late)
        _changes(spark, root)
    _land(spark, root, "2025-01-01 11:00:00", "S2", "T2", 7)  # hours late, another key
    assert _changes(spark, root) == [("S", "T", 1, "01 10:00"), ("S", "T", 2, "01 15:00"), ("S2", "T2", 7, "01 11:00")]


def test_document_from_before_the_reset(spark):
    root = f"{checkpoint_root(spark)}/test-reset-{uuid.uuid4().hex}"
    for at in ("02:00", "04:30", "02:30"):  # the third belongs to the day that the second has ended
        _land(spark, root, f"2025-01-02 {at}:00", "S", "T", 5)
        got = _changes(spark, root)
    assert got == [("S", "T", 5, "02 02:00"), ("S", "T", 5, "02 04:30")]


def test_collector_rules_and_rejects(spark):
    root = f"{checkpoint_root(spark)}/test-rules-{uuid.uuid4().hex}"
    _land(spark, root, "2025-01-01 04:00:00", "S", "night", 5)
    _land(spark, root, "2025-01-01 12:00:00", "S", "bus", 5, train_type="Bus")
    _land(spark, root, "2025-01-01 12:00:00", "S", "to-heuston", 5, destination="Dublin Heuston")
    _land(spark, root, "2025-01-01 12:00:00", "HSTON", "at-hston", 5)
    _land(spark, root, "2025-01-01 12:00:00", "S", "plain", 5)
    land(spark.sql("select 'S' board_station, timestamp_ntz'2025-01-01 12:00:00' polled_at, '<Arr<broken' payload"), f"{root}/landing")
    got = {}
    for scope in (CONNOLLY, HEUSTON):
        start_collect(spark, f"{root}/landing", f"{root}/{scope}", f"{root}/ckpt-{scope}", scope=scope,
                      trigger={"availableNow": True}).awaitTermination()
        got[scope] = {r.train_code for r in ParquetStore(spark, f"{root}/{scope}").trips().collect()}
    assert got == {CONNOLLY: {"at-hston", "plain"}, HEUSTON: {"at-hston", "to-heuston"}}
    start_rejects(spark, f"{root}/landing", f"{root}/store", f"{root}/ckpt-r", trigger={"availableNow": True}).awaitTermination()
    assert [r.payload for r in spark.read.parquet(f"{root}/store/rejects").collect()] == ["<Arr<broken"]
