import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from railpulse.session import get_spark  # noqa: E402
from railpulse.sources.tables import FrameData  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="railpulse-tests", shuffle_partitions=4)
    yield s
    s.stop()


TRIP_ROWS = [
    (1, "E801", "12 May 2025", "DART", "Bray", "Howth", "Northbound"),
    (2, "E802", "12 May 2025", "DART", "Howth", "Bray", "Southbound"),
    (3, "A203", "12 May 2025", "Train", "Dublin Heuston", "Cork", "To Cork"),
    (4, "P601", "13 May 2025", "Train", None, "", "Northbound"),
    (5, "E900", "13 May 2025", "DART", "Malahide", "Bray", "Southbound"),
]


def _ts(s):
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M")


SNAP_ROWS = [
    (1, 1, "CNLLY", "Dublin Connolly", "CONNOLLY", "08:00", "07:59", 4, _ts("2025-05-12 08:01")),
    (2, 1, "CNLLY", "Dublin Connolly", "CONNOLLY", "08:00", "07:59", 9, _ts("2025-05-12 08:06")),
    (3, 1, "TARA", "Tara Street", "CONNOLLY", "08:04", "08:03", 9, _ts("2025-05-12 08:07")),
    (4, 2, "cnlly", "Dublin Connolly", None, "09:00", "08:59", 0, _ts("2025-05-12 09:01")),
    (5, 2, "PERSE", "Dublin Pearse", None, "09:05", "09:04", -2, _ts("2025-05-12 09:05")),
    (6, 3, "HSTON", "Dublin Heuston", "HEUSTON", "10:00", "", 40, _ts("2025-05-12 10:30")),
    (7, 3, "KDARE", "Kildare", None, "10:30", "10:29", 45, _ts("2025-05-12 11:10")),
    (8, 3, "KDARE", "Kildare", None, "10:30", "10:29", 600, _ts("2025-05-12 11:11")),
    (9, 4, "HSTON", "Dublin Heuston", None, "23:50", "23:49", 5, _ts("2025-05-12 23:55")),
    (10, 4, "HSTON", "Dublin Heuston", None, "23:50", "23:49", 10, _ts("2025-05-13 00:05")),
    (11, 4, "CNLLY", "Dublin Connolly", "CONNOLLY", "00:10", "00:09", 10, _ts("2025-05-13 00:10")),
]

TRIP_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("trip_id", T.LongType()), ("train_code", T.StringType()), ("train_date", T.StringType()),
    ("train_type", T.StringType()), ("origin", T.StringType()), ("destination", T.StringType()),
    ("direction", T.StringType())]])
SNAP_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("id", T.LongType()), ("trip_id", T.LongType()), ("station_code", T.StringType()),
    ("station_full_name", T.StringType()), ("service_scope", T.StringType()), ("sch_depart", T.StringType()),
    ("sch_arrival", T.StringType()), ("late_minutes", T.IntegerType()), ("captured_at", T.TimestampNTZType())]])


@pytest.fixture(scope="session")
def golden(spark):
    from pyspark.sql import functions as F
    trips = spark.createDataFrame(TRIP_ROWS, TRIP_SCHEMA)
    snaps = spark.createDataFrame(SNAP_ROWS, SNAP_SCHEMA)
    for c in ("exp_depart", "exp_arrival", "status"):
        snaps = snaps.withColumn(c, F.lit(None).cast("string"))
    return FrameData(spark, snaps, trips)
