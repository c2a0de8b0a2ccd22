"""Semantic constants.

FIXED VALUES: the values below must equal the reference application's for the
reports to give the same answers.  They are stated here once, in natural order.
"""

from __future__ import annotations

import datetime as _dt

# --- fixed values ---------------------------------------------------------
# A trip is "delayed" when its peak lateness is at least this many minutes.
DELAYED_MIN = 5
# Snapshots later than this many minutes are outliers and dropped before
# aggregation in every capped report.
MAX_STAT_DELAY = 500

# Delay categories: (name, lowest minute, highest minute or None if open).
CATEGORIES = (
    ("On Time", 0, 4),
    ("Small Delay", 5, 9),
    ("Medium Delay", 10, 19),
    ("Big Delay", 20, 39),
    ("Extreme Delay", 40, None),
)
# Display labels: bare name for On Time, "<name> (a–b min)" with an en dash,
# and "<name> (a+ min)" for the open-ended category.
CATEGORY_LABELS = (
    "On Time",
    "Small Delay (5–9 min)",
    "Medium Delay (10–19 min)",
    "Big Delay (20–39 min)",
    "Extreme Delay (40+ min)",
)

# Service scopes and the station codes that name them.
CONNOLLY = "CONNOLLY"
HEUSTON = "HEUSTON"
CONNOLLY_CODE = "CNLLY"
HEUSTON_CODE = "HSTON"
ALL_SCOPES = (CONNOLLY, HEUSTON)
# Text that marks a trip endpoint as Heuston-related (case-insensitive).
HEUSTON_TEXT = "heuston"
# Built-in catalogue rows added when a scope's catalogue lacks its terminus:
# (code, description, alias).
DEFAULT_STATIONS = (
    ("CNLLY", "Dublin Connolly", "Connolly"),
    ("HSTON", "Dublin Heuston", "Heuston"),
)
# Station types collected per scope.
CONNOLLY_STATION_TYPES = "D"
HEUSTON_STATION_TYPES = "M,S"
TRACKED_STATION_CODES = "CNLLY,HSTON"

# Lower bound used when a report's "from" date is open.
EPOCH = _dt.date(2000, 1, 1)
# History kept by the retention job, in days.
RETENTION_DAYS = 90
# Collector guard: active when the wall clock is after 05:59:59 or before 00:31.
SERVICE_START_AFTER = "05:59:59"
SERVICE_END_BEFORE = "00:31:00"
# The change-detection state is cleared daily at this hour.
DAILY_RESET_HOUR = 3

# Row limits of the reports.
LIMIT_STATIONS = 15
LIMIT_ROUTES = 15
LIMIT_TRIPS = 10
LIMIT_DESTINATIONS = 10
LIMIT_TRAINS = 10
LIMIT_RECENT_TRIPS = 5
LIMIT_RECENT_ROWS = 50
LIMIT_DAYS = 30

# Reliability bands by delay probability (percent): below 20, below 40, else.
BAND_LOW_BELOW = 20
BAND_MEDIUM_BELOW = 40
# Live board text for a train due now.
DUE_NOW_TEXT = "A chegar"
# --- end of fixed values --------------------------------------------------

UNKNOWN_ENDPOINT = "Unknown"
# Rows of a frame up to which it is broadcast, where a limit or a count proves that it has no more.
BROADCAST_LIMIT = 10_000
