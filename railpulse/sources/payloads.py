"""Landed XML payloads: live departure boards and station catalogues.

Payload documents arrive as files (one document per file) or as a string
column.  Parsing is Spark's built-in ``from_xml`` + ``explode``: unknown
elements are ignored, a namespace on the root is accepted, an empty root or a
malformed document yields no rows, and missing integer fields read as 0 (the
reference maps them to Java ``int``).

Binding C renders payloads from the test tables with string expressions so the parse
path is exercised on data that grows with the scale factor: one live payload
per (station, poll instant) — the departures board of one station, bounded by
the API's look-ahead window — and station catalogue payloads of at most
``CATALOG_PAGE`` stations each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.expr import hhmmss
from railpulse.sources.bindings import TpchBinding, read_table
from railpulse.sources.tables import few

LIVE_ROOT = "ArrayOfObjStationData"
LIVE_ELEMENT = "objStationData"
STATION_ROOT = "ArrayOfObjStation"
STATION_ELEMENT = "objStation"
# Default namespace written on rendered documents; parsing ignores namespaces.
NAMESPACE = "urn:railpulse:realtime"

# XML element name -> canonical column.
LIVE_FIELDS = (
    ("Traincode", "train_code", "STRING"),
    ("Stationfullname", "station_full_name", "STRING"),
    ("Stationcode", "station_code", "STRING"),
    ("Querytime", "query_time", "STRING"),
    ("Traindate", "train_date", "STRING"),
    ("Origin", "origin", "STRING"),
    ("Destination", "destination", "STRING"),
    ("Origintime", "origin_time", "STRING"),
    ("Destinationtime", "destination_time", "STRING"),
    ("Status", "status", "STRING"),
    ("Lastlocation", "last_location", "STRING"),
    ("Duein", "due_in", "INT"),
    ("Late", "late_minutes", "INT"),
    ("Exparrival", "exp_arrival", "STRING"),
    ("Expdepart", "exp_depart", "STRING"),
    ("Scharrival", "sch_arrival", "STRING"),
    ("Schdepart", "sch_depart", "STRING"),
    ("Direction", "direction", "STRING"),
    ("Traintype", "train_type", "STRING"),
    ("Locationtype", "location_type", "STRING"),
)
STATION_FIELDS = (
    ("StationDesc", "station_desc", "STRING"),
    ("StationAlias", "station_alias", "STRING"),
    ("StationLatitude", "latitude", "DOUBLE"),
    ("StationLongitude", "longitude", "DOUBLE"),
    ("StationCode", "station_code", "STRING"),
    ("StationId", "station_id", "INT"),
)
CATALOG_PAGE = 16
POLL_PAGE = 256


def _schema(element: str, fields) -> str:
    inner = ", ".join(f"{x}: {t}" for x, _, t in fields)
    return f"{element} ARRAY<STRUCT<{inner}>>"


LIVE_SCHEMA = _schema(LIVE_ELEMENT, LIVE_FIELDS)
STATION_SCHEMA = _schema(STATION_ELEMENT, STATION_FIELDS)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: (path, payload)."""
    return (spark.read.option("wholetext", "true").text(path)
            .select(F.input_file_name().alias("path"), F.col("value").alias("payload")))


# No field is an attribute, so the parser need not gather any.
PARSE_OPTIONS = {"excludeAttribute": "true"}


def parse_live(df: DataFrame, payload: str = "payload", columns: Iterable[str] | None = None) -> DataFrame:
    """O-S1: explode live rows out of payload documents (other columns kept).

    ``columns`` are the fields that the caller reads, all if none are given; the parser passes over the others.
    """
    keep = [c for c in df.columns if c != payload]
    fields = [f for f in LIVE_FIELDS if columns is None or f[1] in set(columns)]
    parsed = df.select(*keep, F.from_xml(F.col(payload), _schema(LIVE_ELEMENT, fields), PARSE_OPTIONS).alias("_doc"))
    rows = parsed.select(*keep, F.posexplode(f"_doc.{LIVE_ELEMENT}").alias("position", "_r"))
    cols = []
    for xml, name, typ in fields:
        c = F.col(f"_r.{xml}")
        if typ == "INT":
            c = F.coalesce(c, F.lit(0))
        cols.append(c.alias(name))
    return rows.select(*keep, "position", *cols)


def malformed(df: DataFrame, schema: str = LIVE_SCHEMA, payload: str = "payload") -> DataFrame:
    """The documents that are not well-formed XML of the schema (a null payload too); they give no rows."""
    doc = F.from_xml(F.col(payload), f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    return df.where(F.col(payload).isNull() | doc["_corrupt"].isNotNull())


def parse_stations(df: DataFrame, payload: str = "payload") -> DataFrame:
    keep = [c for c in df.columns if c != payload]
    parsed = df.select(*keep, F.from_xml(F.col(payload), STATION_SCHEMA).alias("_doc"))
    rows = parsed.select(*keep, F.posexplode(f"_doc.{STATION_ELEMENT}").alias("position", "_r"))
    cols = []
    for xml, name, typ in STATION_FIELDS:
        c = F.col(f"_r.{xml}")
        if typ in ("INT", "DOUBLE"):
            c = F.coalesce(c, F.lit(0).cast(typ.lower()))
        cols.append(c.alias(name))
    return rows.select(*keep, "position", *cols)


def xml_text(col) -> F.Column:
    """XML text escaping of a value (&, <, >)."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def xml_element(tag: str, fields) -> F.Column:
    """``<tag><Field>value</Field>…</tag>`` from (xml name, column) pairs with
    plain string expressions; NULL fields are omitted, '' is an empty element
    (the same document ``to_xml`` writes, without a per-row XML writer)."""
    parts = [F.when(col.isNotNull(), F.concat(F.lit(f"<{xml}>"), xml_text(col), F.lit(f"</{xml}>")))
             for xml, col in fields]
    return F.concat(F.lit(f"<{tag}>"), F.concat_ws("", *parts), F.lit(f"</{tag}>"))


def _document(elements_sorted: F.Column, root: str) -> F.Column:
    return F.concat(F.lit(f'<{root} xmlns="{NAMESPACE}">'), F.array_join(elements_sorted, ""),
                    F.lit(f"</{root}>"))


# ---------------------------------------------------------------------------
# Binding C: payloads rendered from the test tables
# ---------------------------------------------------------------------------

def live_train_type(priority) -> F.Column:
    p = F.col(priority) if isinstance(priority, str) else priority
    return (F.when(p == "5-LOW", F.lit("Bus"))
            .when(p == "4-NOT SPECIFIED", F.lit(None).cast("string"))
            .otherwise(F.lit("DART")))


def live_source_rows(spark: SparkSession, sf_dir: str, newest: bool = False) -> DataFrame:
    """The live rows binding C publishes: binding A snapshots with trip columns;
    with ``newest`` only those of each station's newest poll, found on the
    snapshot columns before any trip is looked up."""
    a = TpchBinding(spark, sf_dir)
    s = a.snapshots()
    if newest:
        last = s.groupBy("station_code").agg(F.max("captured_at").alias("captured_at"))
        s = s.join(last, ["station_code", "captured_at"], "left_semi")
    return _live_columns(s.join(a.trips(), "trip_id"))


def newest_source_rows(spark: SparkSession, sf_dir: str, trips: DataFrame) -> DataFrame:
    """The rows of ``live_source_rows(newest=True)``, written in the shared folder, by binding A's trips that the caller
    has written.

    Stations, and the rows of their newest polls, are few as a rule; then neither the history nor the trips are shuffled.
    """
    s = TpchBinding(spark, sf_dir).snapshots()
    last = few(s.groupBy("station_code").agg(F.max("captured_at").alias("captured_at")))
    newest = few(s.join(last, ["station_code", "captured_at"], "left_semi"))
    return _live_columns(newest.join(trips, "trip_id")).checkpoint(eager=True)


def _live_columns(j: DataFrame) -> DataFrame:
    return j.select(
        "trip_id", "captured_at",
        F.col("train_code"), F.col("station_full_name"), F.col("station_code"),
        hhmmss("captured_at").alias("query_time"),
        F.col("train_date"), F.col("origin"), F.col("destination"),
        F.lit(None).cast("string").alias("origin_time"),
        F.lit(None).cast("string").alias("destination_time"),
        F.lit("En Route").alias("status"),
        F.lit(None).cast("string").alias("last_location"),
        F.pmod(F.col("trip_id"), F.lit(30)).cast("int").alias("due_in"),
        F.col("late_minutes"),
        F.lit(None).cast("string").alias("exp_arrival"),
        F.lit(None).cast("string").alias("exp_depart"),
        F.col("sch_arrival"), F.col("sch_depart"), F.col("direction"),
        live_train_type("train_type").alias("train_type"),
        F.lit("S").alias("location_type"),
    )


def poll_documents(rows: DataFrame, poll: list[str], order: list[str], deal: list[str]) -> DataFrame:
    """(poll columns, page, payload): the live rows of each poll as XML documents, in ``order`` within a page.

    A poll of more than ``POLL_PAGE`` rows has several pages: its rows are dealt by a hash of ``deal``, the columns
    whose equal rows must stay in order, so a page holds about that many.  Of rows that are equal throughout the
    copies are dealt over the pages, so no document grows with their number.
    """
    fields = list(dict.fromkeys([*order, *(name for _, name, _ in LIVE_FIELDS)]))
    keyed = rows.select(*poll, F.struct(*fields).alias("e"), F.xxhash64(*deal).alias("h"))
    sizes = keyed.groupBy(*poll).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > POLL_PAGE)
    if sizes.isEmpty():
        by, paged = poll, keyed.select(*poll, "e", F.lit(1).alias("copies"))
    else:
        copies = keyed.groupBy(*poll, "e", "h").agg(F.count(F.lit(1)).alias("c"))
        known = sizes.select(*[F.col(c).alias(f"_{c}") for c in poll], F.ceil(F.col("n") / POLL_PAGE).alias("pages"))
        on = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in poll])
        pages = F.coalesce(F.col("pages"), F.lit(1))
        parted = copies.join(known, on, "left").select(
            *poll, "e", "h", "c", pages.alias("pages"), F.explode(F.sequence(F.lit(0), F.least(F.col("c"), pages) - 1)).alias("k"))
        by, paged = [*poll, "page"], parted.select(
            *poll, "e", F.pmod(F.col("h") + F.col("k"), F.col("pages")).cast("int").alias("page"),
            (F.floor(F.col("c") / F.col("pages")) + (F.col("k") < F.col("c") % F.col("pages")).cast("int")).cast("int").alias("copies"))
    # Rows travel to their page as values and become XML there.  Equal rows are neighbours in it, so one text stands for its copies.
    elem = F.repeat(xml_element(LIVE_ELEMENT, [(xml, F.col(f"e.{name}")) for xml, name, _ in LIVE_FIELDS]), F.col("copies"))
    sort = [F.col(f"e.{c}").alias(f"o{i}") for i, c in enumerate(order)]
    docs = paged.repartition(*by).select(*by, F.struct(*sort, elem.alias("xml")).alias("x")) \
        .groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    page = F.col("page") if "page" in by else F.lit(0).alias("page")
    return docs.select(*poll, page, _document(F.col("xs.xml"), LIVE_ROOT).alias("payload"))


def live_payloads(spark: SparkSession, sf_dir: str, newest: bool = False, trips: DataFrame | None = None) -> DataFrame:
    """(station_code, captured_at, page, payload): the board documents of each station poll,
    or with ``newest`` only those of each station's newest.  A caller that has written the trips can hand them over."""
    rows = live_source_rows(spark, sf_dir, newest) if trips is None or not newest else newest_source_rows(spark, sf_dir, trips)
    return poll_documents(rows, ["station_code", "captured_at"],
                          ["trip_id", "sch_depart", "late_minutes"], ["train_code", "train_date", "sch_depart"])


def station_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station catalogue rows derived from ``supplier`` (code by key mod 20)."""
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    m = F.pmod(k, F.lit(20))
    code = (F.when(m == 0, F.lit("HSTON")).when(m == 1, F.lit("CNLLY")).when(m == 2, F.lit("cnlly"))
            .otherwise(F.concat(F.lit("ST"), m.cast("string"))))
    types = F.array(F.lit("D"), F.lit("M"), F.lit("S"))
    return s.select(
        k.alias("station_id_long"),
        F.element_at(types, (F.pmod(F.floor(k / 20), F.lit(3)) + 1).cast("int")).alias("station_type"),
        F.col("s_name").alias("station_desc"),
        F.when(F.pmod(k, F.lit(4)) == 0, F.lit("")).when(F.pmod(k, F.lit(4)) == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Alias "), k.cast("string"))).alias("station_alias"),
        (F.col("s_acctbal") / 100.0).alias("latitude"),
        (-F.col("s_acctbal") / 200.0).alias("longitude"),
        code.alias("station_code"),
        k.cast("int").alias("station_id"),
    )


def station_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_type, page, payload): catalogue pages of at most CATALOG_PAGE stations."""
    rows = station_source_rows(spark, sf_dir)
    elem = xml_element(STATION_ELEMENT, [(xml, F.col(name)) for xml, name, _ in STATION_FIELDS])
    keyed = rows.select("station_type", F.floor(F.col("station_id_long") / CATALOG_PAGE).alias("page"),
                        F.struct("station_id_long", elem.alias("xml")).alias("e"))
    docs = keyed.groupBy("station_type", "page").agg(F.collect_list("e").alias("es"))
    return docs.select("station_type", "page",
                       _document(F.transform(F.array_sort("es"), lambda e: e["xml"]), STATION_ROOT)
                       .alias("payload"))
