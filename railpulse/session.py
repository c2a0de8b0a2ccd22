"""Spark session helpers.

Cluster deployments pass their own configuration (``spark-submit --conf``, an
already running session); ``get_spark`` fills in only settings that nobody has
set, so it is safe to call on a cluster as well as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings applied when the caller has not set them.  AQE re-plans joins and
# coalesces shuffle partitions at runtime; skew-join splitting handles hot keys
# that survive the map-side partial aggregation.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(master: str | None = None, app: str = "railpulse",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    # pandas deprecation chatter from Arrow batch concatenation in workers.
    os.environ.setdefault("PYTHONWARNINGS", "ignore::FutureWarning")
    running = SparkSession.getActiveSession()
    submitted = SparkConf()  # what spark-submit and the defaults file have set

    def is_set(key: str) -> bool:
        return submitted.contains(key) or running is not None and running._jsparkSession.conf().contains(key)

    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        if not is_set(key):
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is respected as is;
    without it there is no folder that all executors see, which is an error.
    Only a local master gets a scratch folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="railpulse-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and stream checkpoints."""
    return ensure_checkpoint_dir(spark)
