"""Landed payload parsing edge cases."""

from railpulse.sources.payloads import parse_live

NS = 'xmlns="http://example.org/realtime/"'


def _rows(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc int, payload string")
    return parse_live(df).orderBy("doc", "position").collect()


def test_edge_cases(spark):
    docs = [
        f"<ArrayOfObjStationData {NS}/>",
        f"<ArrayOfObjStationData {NS}><objStationData><Traincode>E1</Traincode><Late>3</Late>"
        "<Duein/><Unknown>x</Unknown></objStationData></ArrayOfObjStationData>",
        "<ArrayOfObjStationData><objStationData><Traincode>E2 &amp; co</Traincode><Late/></objStationData>"
        "<objStationData><Traincode>E3</Traincode><Late>-4</Late><Duein>12</Duein></objStationData>"
        "</ArrayOfObjStationData>",
        "this is not xml <",
        "",
    ]
    rows = _rows(spark, docs)
    got = [(r.doc, r.train_code, r.late_minutes, r.due_in) for r in rows]
    assert got == [(1, "E1", 3, 0), (2, "E2 & co", 0, 0), (2, "E3", -4, 12)]


def test_render_round_trip(spark):
    """Rendered elements parse back to the same values: escaping, '' vs NULL."""
    from pyspark.sql import functions as F

    from railpulse.sources.payloads import LIVE_ELEMENT, LIVE_ROOT, _document, xml_element
    src = spark.createDataFrame([("A&B <x>", "", None, 7)], "code string, origin string, dest string, late int")
    elem = xml_element(LIVE_ELEMENT, [("Traincode", F.col("code")), ("Origin", F.col("origin")),
                                      ("Destination", F.col("dest")), ("Late", F.col("late"))])
    doc = src.select(_document(F.array(elem), LIVE_ROOT).alias("payload"))
    r = parse_live(doc).first()
    assert (r.train_code, r.origin, r.destination, r.late_minutes, r.due_in) == ("A&B <x>", "", None, 7, 0)
