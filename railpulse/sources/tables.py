"""Canonical rail tables.

Reports read a :class:`RailData`: ``snapshots(window)`` and ``trips()``.  Two
implementations exist:

* :class:`ParquetStore` – the production layout: snapshots partitioned by
  ``service_date`` (a window prunes partitions), trips and metrics as Parquet.
* :class:`~railpulse.sources.bindings.TpchBinding` – canonical views derived
  by Spark from the driver's TPC-H style tables, used for tests and benches.

Canonical schemas (FIXTURES.md section 1):

``trip``: trip_id bigint, train_code, train_date, train_type, origin,
destination, direction string.

``snapshot``: trip_id bigint, station_code, station_full_name, service_scope,
sch_depart, sch_arrival, exp_depart, exp_arrival, status string,
late_minutes int, captured_at timestamp_ntz (+ optional id bigint,
service_date date, resolved_scope string).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.functions.constants import BROADCAST_LIMIT
from railpulse.functions.ranges import TimeRange
from railpulse.session import ensure_checkpoint_dir
from railpulse.sources import folders
from railpulse.sources.commits import CommitLog, Version

TRIP_SCHEMA = T.StructType([
    T.StructField("trip_id", T.LongType(), False),
    T.StructField("train_code", T.StringType()),
    T.StructField("train_date", T.StringType()),
    T.StructField("train_type", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("direction", T.StringType()),
])

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("trip_id", T.LongType(), False),
    T.StructField("station_code", T.StringType()),
    T.StructField("station_full_name", T.StringType()),
    T.StructField("service_scope", T.StringType()),
    T.StructField("sch_depart", T.StringType()),
    T.StructField("sch_arrival", T.StringType()),
    T.StructField("exp_depart", T.StringType()),
    T.StructField("exp_arrival", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("late_minutes", T.IntegerType(), False),
    T.StructField("captured_at", T.TimestampNTZType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("service_date", T.DateType(), False),
    T.StructField("service_scope", T.StringType(), False),
    T.StructField("station_code", T.StringType(), False),
    T.StructField("station_full_name", T.StringType()),
    T.StructField("origin", T.StringType(), False),
    T.StructField("destination", T.StringType(), False),
    T.StructField("total_snapshots", T.LongType()),
    T.StructField("unique_trips", T.LongType()),
    T.StructField("delayed_trips", T.LongType()),
    T.StructField("on_time_trips", T.LongType()),
    T.StructField("average_delay_minutes", T.DoubleType()),
    T.StructField("max_delay_minutes", T.IntegerType()),
    T.StructField("total_delay_minutes", T.LongType()),
    T.StructField("small_delay_trips", T.LongType()),
    T.StructField("medium_delay_trips", T.LongType()),
    T.StructField("big_delay_trips", T.LongType()),
    T.StructField("extreme_delay_trips", T.LongType()),
    T.StructField("updated_at", T.TimestampType()),
])


def few(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder, and broadcast if it turned out to have few rows."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    return F.broadcast(df) if df.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT else df


class RailData:
    """Interface of a snapshot/trip source."""

    spark: SparkSession
    #: Whether every snapshot is known to have its trip.
    trips_complete = False

    def snapshots(self, window: TimeRange | None = None) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def trips(self) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def first_and_last_day(self) -> tuple[dt.date, dt.date] | None:
        """Service dates between which all snapshots lie; None if there are none."""
        r = self.snapshots().agg(F.to_date(F.min("captured_at")).alias("a"), F.to_date(F.max("captured_at")).alias("b")).first()
        return None if r["a"] is None else (r["a"], r["b"])


STATES_SCHEMA = T.StructType([
    T.StructField("service_date", T.DateType()),
    T.StructField("service_scope", T.StringType()),
    T.StructField("station_code", T.StringType()),
    T.StructField("station_full_name", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("trip_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("p", T.IntegerType()),
])

BATCH = "batch_id"  # partition column that names who wrote a folder; not part of the tables


class ParquetStore(RailData):
    """Tables below a root: ``snapshots``, ``metrics`` and ``states`` in folders ``service_date=D/batch_id=B``, ``trips`` in
    ``batch_id=B``.

    Which folders count is said by the commit log (:mod:`railpulse.sources.commits`).  A table that the log does not
    name is read as the plain Parquet folder that it is.  ``at(version)`` is the store as of one version, whatever is
    committed meanwhile.
    """

    def __init__(self, spark: SparkSession, root: str, version: Version | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = CommitLog(spark, self.root)
        self.version = version

    def at(self, version: Version) -> "ParquetStore":
        return ParquetStore(self.spark, self.root, version)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    @property
    def snapshots_path(self) -> str:
        return self.path("snapshots")

    @property
    def trips_path(self) -> str:
        return self.path("trips")

    @property
    def metrics_path(self) -> str:
        return self.path("metrics")

    def latest(self) -> Version:
        """The newest version.  A store without a log gets a first one of the folders that it has."""
        found = self.log.latest()
        while found is None:
            self.log.create(Version(0, {t: tuple(self._leaves(t)) for t in ("trips", "snapshots", "states", "metrics")}))
            found = self.log.latest()
        return found

    def _leaves(self, table: str, below: str = "") -> list[str]:
        """Folders of a table without partition folders in them."""
        path = f"{self.path(table)}/{below}".rstrip("/")
        parts = [n for n in folders.children(self.spark, path, "") if "=" in n and not n.startswith((".", "_"))]
        if parts:
            return [x for n in parts for x in self._leaves(table, f"{below}/{n}".lstrip("/"))]
        return [below or "."] if folders.has_data(self.spark, path) else []

    def places(self, table: str, name: str) -> list[str]:
        """What to read for a folder: a folder that is no batch's may have got those of batches since, so its files."""
        path = self.path(table) if name == "." else f"{self.path(table)}/{name}"
        return [path] if name.split("/")[-1].startswith(f"{BATCH}=") else folders.files(self.spark, path)

    def read_folders(self, table: str, names, schema: T.StructType) -> DataFrame:
        """The rows of some folders of a table."""
        alike: dict[tuple[str, ...], list[str]] = {}  # Spark wants the same partition columns throughout
        for n in names:
            alike.setdefault(tuple(x.split("=")[0] for x in n.split("/") if "=" in x), []).append(n)
        out = None
        for some in alike.values():
            # Dates are the only partition values; names of batches are no numbers.
            df = self.spark.read.option("basePath", self.path(table)).parquet(*[x for n in some for x in self.places(table, n)]).drop(BATCH)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _read(self, table: str, schema: T.StructType, days: tuple[str, str] | None = None) -> DataFrame:
        version = self.version or self.log.latest()
        if version is not None and table in version.tables:
            names = version.of(table)
            if days is not None:  # folders without a date in their name may hold any
                names = [n for n in names if not n.startswith("service_date=") or days[0] <= n.split("/")[0].split("=")[1] < days[1]]
            return self.read_folders(table, names, schema)
        # A table that was never written, or has lost its last partition, is empty; every other error is one.
        if not folders.has_data(self.spark, self.path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.path(table))

    def snapshots(self, window: TimeRange | None = None) -> DataFrame:
        schema = T.StructType(SNAPSHOT_SCHEMA.fields + [T.StructField("service_date", T.DateType())])
        if window is None:
            return self._read("snapshots", schema)
        lo, hi = window.start_date, window.end_date_exclusive
        df = self._read("snapshots", schema, (lo.isoformat(), hi.isoformat()))
        # The date predicate prunes partitions of a plain folder; the timestamp one is exact.
        return df.where((F.col("service_date") >= F.lit(lo)) & (F.col("service_date") < F.lit(hi))
                        & window.predicate("captured_at"))

    def first_and_last_day(self) -> tuple[dt.date, dt.date] | None:
        names = self.latest().of("snapshots") if self.version is None else self.version.of("snapshots")
        days = {n.split("/")[0].removeprefix("service_date=") for n in names}
        if not all(d[:4].isdigit() for d in days):  # rows without a date, or a table that is not laid out by it
            return super().first_and_last_day()
        return (dt.date.fromisoformat(min(days)), dt.date.fromisoformat(max(days))) if days else None

    def trips(self) -> DataFrame:
        return self._read("trips", TRIP_SCHEMA)

    def metrics(self) -> DataFrame:
        return self._read("metrics", METRICS_SCHEMA)


class FrameData(RailData):
    """In-memory frames (tests, fixtures, streaming micro-batches)."""

    def __init__(self, spark: SparkSession, snapshots: DataFrame, trips: DataFrame):
        self.spark = spark
        self._s = snapshots
        self._t = trips

    def snapshots(self, window: TimeRange | None = None) -> DataFrame:
        return self._s if window is None else self._s.where(window.predicate("captured_at"))

    def trips(self) -> DataFrame:
        return self._t
