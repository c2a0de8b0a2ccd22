"""Live departure rows: board filters, routing to scopes, board counters and
per-row scalars (O-P9, O-P10, O-P11, O-T6, O-A19, §2.9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions.constants import DELAYED_MIN, HEUSTON, HEUSTON_CODE
from railpulse.functions.expr import category_label, delay_category, due_in_display, is_delayed
from railpulse.functions.scope import heuston_trip
from railpulse.operators.catalog import normalize_code, station_roles
from railpulse.sources.payloads import parse_live


def not_bus(train_type="train_type") -> Column:
    """O-P9: drop road services; a NULL type is kept."""
    return ~(F.lower(F.coalesce(F.col(train_type), F.lit(""))) == F.lit("bus"))


def board_filter(include_heuston: Column | bool) -> Column:
    """O-P10: Heuston-related trains only when the board asks for them."""
    inc = F.lit(include_heuston) if isinstance(include_heuston, bool) else include_heuston
    return not_bus() & (inc | ~heuston_trip())


def latest_payloads(payloads: DataFrame) -> DataFrame:
    """The newest board document per station.

    The newest poll instant per station is a hash aggregate over two
    fixed-size columns; a left-semi join then keeps only those documents, so
    older boards are not parsed.
    """
    newest = payloads.groupBy("station_code").agg(F.max("captured_at").alias("captured_at"))
    return payloads.join(newest, ["station_code", "captured_at"], "left_semi") \
        .select("station_code", "payload", "captured_at")


def live_board(payloads: DataFrame) -> DataFrame:
    """O-T6: current rows of every station's board after the board filters;
    Heuston trains are included automatically at HSTON."""
    return board_rows(latest_payloads(payloads))


def board_rows(latest: DataFrame) -> DataFrame:
    """Rows of boards of which there is one document per station."""
    rows = parse_live(latest.withColumnRenamed("station_code", "board_station"))
    at_heuston = normalize_code("board_station") == F.lit(HEUSTON_CODE)
    return rows.where(board_filter(at_heuston))


def board_counts(board: DataFrame, min_delay: int = DELAYED_MIN) -> DataFrame:
    """O-A19: per board, trains, late trains (>= min_delay) and the rest."""
    late = is_delayed("late_minutes", min_delay)
    return board.groupBy("board_station").agg(
        F.count(F.lit(1)).alias("trains"),
        F.sum(F.when(late, 1).otherwise(0)).cast("long").alias("late_trains"),
    ).withColumn("on_time_trains", F.col("trains") - F.col("late_trains"))


def route_live_rows(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """O-P11: stamp each live row with the scope(s) that collect it.

    CONNOLLY collects its stations' non-Heuston trains; HEUSTON collects the
    Heuston-related trains of its stations, and every train at HSTON.  Road
    services are dropped in both.  The station-role table is one row per
    (station, scope); AQE broadcasts it when its measured size is small.
    """
    roles = station_roles(catalog)
    keyed = rows.withColumn("_code", normalize_code("board_station"))
    j = keyed.join(roles, keyed["_code"] == roles["code"], "inner").drop("code")
    related = heuston_trip()
    at_hston = F.col("_code") == F.lit(HEUSTON_CODE)
    keep = not_bus() & F.when(F.col("service_scope") == F.lit(HEUSTON), related | at_hston) \
        .otherwise(~related)
    return j.where(keep).drop("_code")


def scope_rows(rows: DataFrame, scope: str) -> DataFrame:
    """O-P9/O-P10 for a collector of one scope: the rows that scope stores."""
    related = heuston_trip()
    at_hston = normalize_code("board_station") == F.lit(HEUSTON_CODE)
    keep = (related | at_hston) if scope == HEUSTON else ~related
    return rows.where(not_bus() & keep).withColumn("service_scope", F.lit(scope))


SCALAR_FIELDS = ("train_code", "station_code", "late_minutes", "due_in")


def live_scalars(rows: DataFrame) -> DataFrame:
    """Per-row derived values of a live row."""
    return rows.select(
        "train_code", "station_code", "late_minutes", "due_in",
        delay_category("late_minutes").alias("category"),
        category_label(delay_category("late_minutes")).alias("category_label"),
        is_delayed("late_minutes").alias("is_late"),
        due_in_display("due_in").alias("due_in_display"),
    )
