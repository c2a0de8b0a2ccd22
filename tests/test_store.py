"""The store keeps its data: read errors are errors, a failed swap changes nothing."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from railpulse.functions.ranges import TimeRange
from railpulse.operators import dataops as D
from railpulse.session import DEFAULTS, get_spark
from railpulse.sources import folders
from railpulse.sources.tables import ParquetStore
from railpulse.streaming.maintenance import maintain


def _store(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    snaps = "1L as trip_id, 'S' as station_code, 'Station' as station_full_name, 'CONNOLLY' as service_scope, '10:00' as sch_depart, '10:00' as sch_arrival, 5 as late_minutes"
    spark.sql(f"select {snaps}, timestamp_ntz'2025-01-05 10:00:00' as captured_at, date'2025-01-05' as service_date, 0 as batch_id") \
        .write.partitionBy("service_date", "batch_id").parquet(store.snapshots_path)
    spark.sql("select id as trip_id, 'T' as train_code, '1 Jan' as train_date, 'DART' as train_type, 'a' as origin, 'b' as destination, 'N' as direction, 0 as batch_id from range(1, 3)") \
        .write.partitionBy("batch_id").parquet(store.trips_path)
    # the collector's newest batch, which maintenance leaves alone
    spark.sql(f"select {snaps}, timestamp_ntz'2025-01-06 10:00:00' as captured_at, date'2025-01-06' as service_date, 1 as batch_id") \
        .write.mode("append").partitionBy("service_date", "batch_id").parquet(store.snapshots_path)
    return store


def test_a_corrupt_file_is_an_error(spark, tmp_path):
    store = _store(spark, tmp_path)
    for folder, _, names in os.walk(f"{tmp_path}/store/snapshots"):
        for n in names:
            if n.endswith(".parquet"):
                open(f"{folder}/{n}", "wb").write(b"not parquet")
                crc = f"{folder}/.{n}.crc"
                if os.path.exists(crc):
                    os.unlink(crc)
    with pytest.raises(Exception):
        store.snapshots().count()
    with pytest.raises(Exception):
        maintain(store, dt.datetime(2025, 1, 20))
    assert store.trips().count() == 2


def test_missing_and_emptied_tables_are_empty(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/none")
    assert store.snapshots().count() == store.trips().count() == store.metrics().count() == 0
    store = _store(spark, tmp_path)
    maintain(store, dt.datetime(2026, 1, 20))
    assert store.snapshots().count() == 0


def test_orphans_go_and_new_batches_stay(spark, tmp_path):
    store = _store(spark, tmp_path)
    maintain(store, dt.datetime(2025, 1, 20))
    assert [r.trip_id for r in store.trips().collect()] == [1]
    assert store.snapshots().count() == 2


def test_a_failed_commit_leaves_the_old_data(spark, tmp_path, monkeypatch):
    store = _store(spark, tmp_path)
    real, calls = folders.rename_new, []

    def fail(s, src, dst):
        calls.append(dst)
        if len(calls) == 2:
            raise OSError("no")
        return real(s, src, dst)
    monkeypatch.setattr(folders, "rename_new", fail)
    with pytest.raises(OSError):
        maintain(store, dt.datetime(2025, 1, 20))
    monkeypatch.undo()
    assert store.trips().count() == 2 and store.snapshots().count() == 2


def test_settings_of_others_are_kept(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Dublin")
    try:
        assert get_spark().conf.get("spark.sql.session.timeZone") == "Europe/Dublin"
    finally:
        spark.conf.set("spark.sql.session.timeZone", DEFAULTS["spark.sql.session.timeZone"])


def test_change_filter_over_midnight(spark):
    rows = spark.createDataFrame([(1, "2025-01-01 23:50:00", 5), (2, "2025-01-02 00:10:00", 5), (3, "2025-01-02 23:50:00", 6),
                                  (4, "2025-01-02 23:55:00", 6), (5, "2025-01-03 02:00:00", 5), (6, "2025-01-03 04:00:00", 5)],
                                 "poll_id int, at string, late_minutes int").select(
        "poll_id", "late_minutes", F.lit("T").alias("train_code"), F.col("at").cast("timestamp_ntz").alias("captured_at"))
    got = lambda **k: sorted(r.poll_id for r in D.state_changes(rows, **k).collect())
    assert got(reset_hour=None) == [1, 3, 5]
    assert got() == [1, 3, 5, 6]


def test_periods():
    now = dt.datetime(2025, 3, 4, 12)
    today = TimeRange.of_dates("2025-03-04", "2025-03-04")
    assert TimeRange.period(None, "", " ", as_of=now) == today == TimeRange.period(None, None, None, as_of=now)
    assert TimeRange.of_dates("20240101", None, now) == TimeRange.of_dates(None, None, now)
