"""Station catalogue operators (O-S2, O-S3, O-U1, O-U2, O-P13).

Catalogue rows come from parsed station payloads (``parse_stations``) with the
requested ``station_type`` and their payload order (``page``, ``position``).

"Distinct, first occurrence wins, sorted by name" is expressed without any
global row numbering: each row gets an ordering struct describing its place in
the concatenated list; the winner per normalised code is the ``min`` of that
struct (a mergeable aggregate), and the final order is a distributed sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.constants import (
    CONNOLLY, CONNOLLY_STATION_TYPES, DEFAULT_STATIONS, HEUSTON, HEUSTON_STATION_TYPES,
    TRACKED_STATION_CODES,
)
from railpulse.functions.expr import station_display_name

STATION_COLS = ("station_desc", "station_alias", "latitude", "longitude", "station_code", "station_id")


def normalize_code(col="station_code") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def parse_type_list(types: str | None) -> list[str]:
    """'M, S' -> ['M', 'S']: split, trim, drop blanks, upper-case."""
    if not types:
        return []
    return [t.strip().upper() for t in types.split(",") if t.strip()]


def stations_by_type(catalog: DataFrame, station_type: str | None) -> DataFrame:
    """O-S2: one type's catalogue in payload order; blank type -> empty."""
    t = (station_type or "").strip().upper()
    return (catalog.where(F.upper(F.trim("station_type")) == F.lit(t))
            .withColumn("_ord", F.struct(F.col("page").cast("long").alias("p"),
                                         F.col("position").cast("long").alias("q"))))


def _name_key() -> Column:
    # Case-insensitive by description, NULL descriptions last.
    return F.struct(F.col("station_desc").isNull().alias("null_desc"),
                    F.lower("station_desc").alias("desc"))


def distinct_sorted(rows: DataFrame, order: Column) -> DataFrame:
    """O-U2: first occurrence per normalised code (by ``order``), blank codes
    dropped; result carries ``_ord`` = its position key in the sorted list."""
    keyed = rows.select(*STATION_COLS, normalize_code().alias("_code"), order.alias("_occ")) \
        .where(F.col("_code") != "")
    first = keyed.groupBy("_code").agg(
        F.min(F.struct(F.col("_occ").alias("occ"), *[F.col(c) for c in STATION_COLS])).alias("w"))
    out = first.select(*[F.col(f"w.{c}").alias(c) for c in STATION_COLS], F.col("w.occ").alias("_occ"))
    # Sorted by name; equal names keep their first-occurrence order (stable sort).
    return out.withColumn("_ord", F.struct(_name_key().alias("name"), F.col("_occ").alias("occ"))) \
        .drop("_occ")


def stations_by_types(catalog: DataFrame, types: str | None) -> DataFrame:
    """O-S3: concatenate the listed types' catalogues, then distinct-sorted."""
    wanted = parse_type_list(types)
    if not wanted:
        return distinct_sorted(catalog.limit(0).withColumn("_o", F.lit(0)), F.lit(0))
    ordinal = F.lit(None).cast("int")
    for i, t in enumerate(wanted):
        ordinal = F.when(F.upper(F.trim("station_type")) == t, F.lit(i)).otherwise(ordinal)
    sel = catalog.where(F.upper(F.trim("station_type")).isin(wanted))
    order = F.struct(ordinal.alias("t"), F.col("page").cast("long").alias("p"),
                     F.col("position").cast("long").alias("q"))
    return distinct_sorted(sel, order)


def _defaults(spark: SparkSession, code: str) -> DataFrame:
    rows = [(desc, alias, 0.0, 0.0, c, 0) for c, desc, alias in DEFAULT_STATIONS if c == code]
    return spark.createDataFrame(
        rows, "station_desc string, station_alias string, latitude double, longitude double, "
              "station_code string, station_id int")


def with_default(stations: DataFrame, code: str) -> DataFrame:
    """Append the built-in terminus row when no station has ``code``
    (case-insensitive) — an anti join against the (tiny) default row."""
    spark = stations.sparkSession
    present = stations.where(F.upper("station_code") == code).select(F.lit(1).alias("_k")).limit(1)
    extra = _defaults(spark, code).withColumn("_k", F.lit(1)).join(present, "_k", "left_anti").drop("_k")
    base = stations.select(*STATION_COLS, F.struct(F.lit(False).alias("tail"), F.col("_ord").alias("o")).alias("_o"))
    add = extra.select(*STATION_COLS, F.struct(F.lit(True).alias("tail"),
                                               F.lit(None).cast(stations.schema["_ord"].dataType).alias("o"))
                       .alias("_o"))
    return distinct_sorted(base.unionByName(add), F.col("_o"))


def collection_stations(catalog: DataFrame, scope: str) -> DataFrame:
    if scope == HEUSTON:
        return with_default(stations_by_types(catalog, HEUSTON_STATION_TYPES), "HSTON")
    return with_default(stations_by_types(catalog, CONNOLLY_STATION_TYPES), "CNLLY")


def all_collection_stations(catalog: DataFrame) -> DataFrame:
    """O-U1: Connolly list followed by the Heuston list, distinct-sorted."""
    c = collection_stations(catalog, CONNOLLY).withColumn("_src", F.lit(0))
    h = collection_stations(catalog, HEUSTON).withColumn("_src", F.lit(1))
    both = c.unionByName(h)
    return distinct_sorted(both, F.struct("_src", "_ord"))


def station_roles(catalog: DataFrame) -> DataFrame:
    """(code, service_scope) for every station collected by each scope."""
    c = collection_stations(catalog, CONNOLLY).select(normalize_code().alias("code"),
                                                      F.lit(CONNOLLY).alias("service_scope"))
    h = collection_stations(catalog, HEUSTON).select(normalize_code().alias("code"),
                                                     F.lit(HEUSTON).alias("service_scope"))
    return c.unionByName(h)


def tracked_stations(catalog: DataFrame, codes: str = TRACKED_STATION_CODES) -> DataFrame:
    """O-P13: collection stations whose code is tracked, plus the built-in
    CNLLY / HSTON rows when tracked but missing."""
    tracked = [c.strip().upper() for c in codes.split(",") if c.strip()]
    out = all_collection_stations(catalog).where(normalize_code().isin(tracked))
    for code, _, _ in DEFAULT_STATIONS:
        if code in tracked:
            out = with_default(out, code)
    return out


def with_display_name(stations: DataFrame) -> DataFrame:
    return stations.withColumn("display_name", station_display_name("station_alias", "station_desc"))


def selected_station_name(stations: DataFrame, code: str) -> DataFrame:
    """O-P14: description of the station whose code matches ``code`` ignoring
    case, else the code itself (one row)."""
    spark = stations.sparkSession
    want = spark.createDataFrame([(code,)], "code string")
    match = stations.where(F.upper("station_code") == code.strip().upper()) \
        .agg(F.min("station_desc").alias("station_desc"))
    return want.withColumn("_k", F.lit(1)).join(match.withColumn("_k", F.lit(1)), "_k", "left") \
        .select(F.coalesce("station_desc", "code").alias("station_name"))
