"""Canonical rail tables derived by Spark from the driver's test tables.

Binding A (batch reports) – ``trip`` from orders ⋈ customer ⋈ nation and
``snapshot`` from lineitem.  Binding B (state changes, service hours, trip
upsert) – ``poll`` from events.  Binding C (landed payloads) – live rows and a
station catalogue rendered as XML documents by Spark from the same tables.
The expressions are listed in FIXTURES.md section 2; the DuckDB oracle in
``railpulse.plans.oracle`` defines the same views in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.ranges import TimeRange, ntz_literal
from railpulse.sources.tables import RailData

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(col: str, n: int):
    return F.pmod(F.col(col), F.lit(n))


class TpchBinding(RailData):
    """Binding A over ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- trip ---------------------------------------------------------------
    def trips(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        # nation is the 25-row TPC-H dimension: a fixed size, safe to broadcast.
        n = F.broadcast(self.table("nation").select("n_nationkey", "n_name"))
        cn = c.join(n, c.c_nationkey == n.n_nationkey, "inner")
        joined = o.join(cn, o.o_custkey == cn.c_custkey, "inner")
        key = F.col("o_orderkey")
        dest_mod = _mod("o_orderkey", 25)
        return joined.select(
            key.alias("trip_id"),
            F.concat(F.lit("E"), _mod("o_custkey", 500).cast("string")).alias("train_code"),
            F.to_date("o_orderdate").cast("string").alias("train_date"),
            F.col("o_orderpriority").alias("train_type"),
            F.when(F.col("c_nationkey") == 0, F.lit(""))
             .when(F.col("c_nationkey") == 1, F.lit(None).cast("string"))
             .when(F.col("c_nationkey") == 2, F.lit("Dublin Heuston"))
             .otherwise(F.col("n_name")).alias("origin"),
            F.when(dest_mod == 3, F.lit("HEUSTON"))
             .when(dest_mod == 4, F.lit(""))
             .otherwise(F.concat(F.lit("DEST_"), dest_mod.cast("string"))).alias("destination"),
            F.when(_mod("o_orderkey", 2) == 0, F.lit("Northbound"))
             .otherwise(F.lit("Southbound")).alias("direction"),
        )

    def first_and_last_day(self) -> tuple[dt.date, dt.date] | None:
        # captured_at is within the day of l_shipdate: one column is enough
        r = self.table("lineitem").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b")).first()
        return None if r["a"] is None else (r["a"], r["b"])

    # -- snapshot -------------------------------------------------------------
    def snapshots(self, window: TimeRange | None = None) -> DataFrame:
        li = self.table("lineitem")
        if window is not None:
            # captured_at = l_shipdate + [0h, 23h59m], so the window implies a
            # bound on l_shipdate that Parquet can use for row-group skipping.
            li = li.where((F.col("l_shipdate") > ntz_literal(window.start) - F.expr("INTERVAL 1 DAY"))
                          & (F.col("l_shipdate") < ntz_literal(window.end)))
        st = _mod("l_suppkey", 20)
        snap = li.select(
            F.col("l_orderkey").alias("trip_id"),
            F.when(st == 0, F.lit("HSTON")).when(st == 1, F.lit("CNLLY")).when(st == 2, F.lit("cnlly"))
             .otherwise(F.concat(F.lit("ST"), st.cast("string"))).alias("station_code"),
            F.concat(F.lit("Station "), st.cast("string")).alias("station_full_name"),
            F.when(F.col("l_returnflag") == "A", F.lit("CONNOLLY"))
             .when(F.col("l_returnflag") == "N", F.lit("HEUSTON")).alias("service_scope"),
            F.col("l_linenumber").cast("string").alias("sch_depart"),
            F.lit(None).cast("string").alias("sch_arrival"),
            F.lit(None).cast("string").alias("exp_depart"),
            F.lit(None).cast("string").alias("exp_arrival"),
            F.lit(None).cast("string").alias("status"),
            F.when(_mod("l_partkey", 97) == 0, F.lit(600))
             .otherwise(F.floor(F.col("l_quantity") * F.col("l_discount") * 12).cast("int") - 4)
             .cast("int").alias("late_minutes"),
            (F.col("l_shipdate")
             + F.make_dt_interval(F.lit(0), _mod("l_partkey", 24).cast("int"),
                                  _mod("l_suppkey", 60).cast("int"), F.lit(0))).alias("captured_at"),
        )
        if window is not None:
            snap = snap.where(window.predicate("captured_at"))
        return snap


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding B: one live reading per event."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("poll_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("train_code"),
        F.upper("event_type").alias("station_code"),
        F.to_date("ts").cast("string").alias("train_date"),
        F.lit(None).cast("string").alias("sch_depart"),
        (F.floor(F.col("value") / 25).cast("int") * 5 - 5).cast("int").alias("late_minutes"),
        F.col("ts").alias("captured_at"),
        F.when(F.col("event_type") == "error", F.lit("Bus"))
         .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
         .otherwise(F.lit("DART")).alias("train_type"),
        F.when(F.pmod("user_id", F.lit(7)) == 0, F.lit("Dublin Heuston"))
         .when(F.pmod("user_id", F.lit(7)) == 1, F.lit(None).cast("string"))
         .otherwise(F.lit("Bray")).alias("origin"),
        F.when(F.col("value") >= 50, F.lit("Howth")).otherwise(F.lit("Greystones")).alias("destination"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit("Northbound"))
         .otherwise(F.lit("Southbound")).alias("direction"),
    )
