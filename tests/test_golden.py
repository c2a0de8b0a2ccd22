"""Hand-checked golden micro-fixture (FIXTURES.md section 3)."""

from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import ScopeFilter
from railpulse.operators import dataops as D
from railpulse.operators import metrics as M
from railpulse.operators import reports as R

WHOLE = TimeRange.of_dates("2025-01-01", "2025-12-31")


def _dash(golden, filt):
    return R.dashboard(golden, WHOLE, filt).first().asDict()


def test_dashboard_network(golden):
    d = _dash(golden, ScopeFilter.scopes())
    assert (d["total_snapshots"], d["unique_trips"], d["delayed_trips"]) == (10, 4, 3)
    assert (d["average_delay"], d["delay_probability"], d["max_delay"]) == (21.3, 75.0, 45)
    assert d["on_time_trips"] == 1


def test_dashboard_scopes(golden):
    c = _dash(golden, ScopeFilter.scope("CNLLY"))
    assert (c["total_snapshots"], c["unique_trips"], c["delayed_trips"], c["average_delay"],
            c["delay_probability"], c["max_delay"]) == (6, 3, 2, 9.5, 66.7, 10)
    h = _dash(golden, ScopeFilter.scope("HSTON"))
    assert (h["total_snapshots"], h["unique_trips"], h["delayed_trips"], h["average_delay"],
            h["delay_probability"], h["max_delay"]) == (4, 2, 2, 27.5, 100.0, 45)
    # Trip 4 is in both scopes: the scopes' trips exceed the network's.
    assert c["unique_trips"] + h["unique_trips"] > _dash(golden, ScopeFilter.scopes())["unique_trips"]
    # Unknown overview codes fall back to CONNOLLY.
    assert _dash(golden, ScopeFilter.scope("XYZ")) == c


def test_categories(golden):
    def cats(filt):
        return [r["trips"] for r in R.delay_categories(golden, WHOLE, filt).orderBy("ordinal").collect()]
    assert cats(ScopeFilter.scopes()) == [1, 1, 0, 1]
    assert cats(ScopeFilter.scope("CNLLY")) == [1, 1, 0, 0]
    assert cats(ScopeFilter.scope("HSTON")) == [0, 1, 0, 1]


def test_hourly(golden):
    rows = {r["hour"]: (r["total"], r["delayed"], r["avg_delay"])
            for r in R.hourly(golden, WHOLE, ScopeFilter.scopes()).collect()}
    assert rows == {0: (2, 2, 10.0), 8: (3, 3, 7.3), 9: (2, 0, 0.0), 10: (1, 1, 40.0),
                    11: (1, 1, 45.0), 23: (1, 1, 5.0)}


def test_top_delays(golden):
    rows = R.top_delayed_trips(golden, WHOLE, ScopeFilter.scopes()).collect()
    got = [(r["train_code"], r["peak_delay"], r["station_full_name"], r["captured_hhmm"], r["snapshot_count"])
           for r in rows]
    assert got == [("A203", 45, "Kildare", "11:10", 2), ("P601", 10, "Dublin Heuston", "00:05", 3),
                   ("E801", 9, "Dublin Connolly", "08:06", 3)]


def test_daily_metrics_and_ranking(golden):
    m = M.build_daily_metrics(golden, with_updated_at=False)
    rows = m.collect()
    assert len(rows) == 9
    assert sum(r["total_snapshots"] for r in rows) == 10
    assert [r["max_delay_minutes"] for r in rows if r["station_code"] == "PERSE"] == [-2]
    rank = {r["station_code"]: (r["total_trips"], r["delayed_trips"], r["total_delay_minutes"])
            for r in M.station_ranking(m, WHOLE, ScopeFilter.scopes()).collect()}
    assert rank == {"HSTON": (3, 3, 55), "CNLLY": (3, 2, 19), "KDARE": (1, 1, 45), "TARA": (1, 1, 9),
                    "PERSE": (1, 0, 0)}


def test_orphans(golden):
    assert [r["trip_id"] for r in D.orphan_trips(golden.trips(), golden.snapshots()).collect()] == [5]


def test_destinations_unknown_and_drop(golden):
    agg = {r["destination"] for r in R.destinations(golden, WHOLE, ScopeFilter.scopes()).collect()}
    assert "Unknown" in agg            # trip 4's '' destination
    raw = {r["destination"] for r in R.destinations(golden, WHOLE, ScopeFilter.network()).collect()}
    assert "Unknown" not in raw and "" not in raw


def test_recent_delays_ignore_window(golden):
    rows = R.recent_delayed_trips(golden, ScopeFilter.scopes()).collect()
    assert [r["train_code"] for r in rows] == ["P601", "A203", "E801"]
    assert rows[0]["captured_hhmm"] == "00:10"


def test_catalogue_defaults(spark):
    """Built-in terminus rows are added only when a scope's list lacks them,
    first occurrence per normalised code wins, blank codes are dropped."""
    from railpulse.operators import catalog as C
    rows = [("D", 0, 0, "Bray", None, 1.0, 2.0, "BRAY", 1),
            ("D", 0, 1, "Bray again", None, 1.0, 2.0, " bray ", 2),
            ("D", 0, 2, "Blank", None, 1.0, 2.0, "  ", 3),
            ("M", 0, 0, "Kildare", "", 1.0, 2.0, "KDARE", 4),
            ("S", 0, 0, "Heuston", "Heuston", 1.0, 2.0, "hston", 5)]
    cat = spark.createDataFrame(rows, "station_type string, page long, position long, station_desc string, "
                                      "station_alias string, latitude double, longitude double, "
                                      "station_code string, station_id int")
    conn = {r.station_code: r.station_desc for r in C.collection_stations(cat, "CONNOLLY").collect()}
    assert conn == {"BRAY": "Bray", "CNLLY": "Dublin Connolly"}
    heu = {r.station_code: r.station_desc for r in C.collection_stations(cat, "HEUSTON").collect()}
    assert heu == {"KDARE": "Kildare", "hston": "Heuston"}
    tracked = {r.station_code for r in C.tracked_stations(cat).collect()}
    assert tracked == {"CNLLY", "hston"}
    name = C.selected_station_name(C.all_collection_stations(cat), "kdare").first()[0]
    assert name == "Kildare"
    assert C.selected_station_name(C.all_collection_stations(cat), "XYZ").first()[0] == "XYZ"
