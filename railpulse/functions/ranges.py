"""Report time windows.

A report window is half-open ``[start, end)`` on ``captured_at``.  Dates given
by the caller are inclusive: ``to_date`` covers the whole day, so the exclusive
bound is the next midnight.  Open bounds follow two conventions found in the
reference (SURVEY Q2):

* ``open_end="instant"``  – repository reports use *as_of + 1 day*;
* ``open_end="midnight"`` – aggregate reports use *midnight after as_of*.

``as_of`` is always explicit so a report is reproducible.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from railpulse.functions.constants import EPOCH


def ntz_literal(value: dt.datetime) -> Column:
    """A wall-clock timestamp literal, independent of any time zone."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _as_date(value) -> dt.date | None:
    """Parse an ISO date; unparseable or blank input means an open bound."""
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    text = str(value).strip()
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return None
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return None


@dataclass(frozen=True)
class TimeRange:
    start: dt.datetime
    end: dt.datetime

    # -- construction -----------------------------------------------------
    @classmethod
    def of_dates(cls, from_date=None, to_date=None, as_of: dt.datetime | None = None,
                 open_end: str = "instant") -> "TimeRange":
        as_of = as_of or dt.datetime.now()
        f = _as_date(from_date)
        t = _as_date(to_date)
        start = dt.datetime.combine(f or EPOCH, dt.time())
        if t is not None:
            end = dt.datetime.combine(t + dt.timedelta(days=1), dt.time())
        elif open_end == "midnight":
            end = dt.datetime.combine(as_of.date() + dt.timedelta(days=1), dt.time())
        else:
            end = as_of + dt.timedelta(days=1)
        return cls(start, end)

    @classmethod
    def period(cls, period: str | None, from_date=None, to_date=None,
               as_of: dt.datetime | None = None, open_end: str = "instant",
               default_today: bool = True) -> "TimeRange":
        """Resolve the request parameters of an analytics page.

        ``period == "all"`` wins and opens both bounds; any explicitly given
        bound disables the default; with no bound at all the default is today.
        """
        as_of = as_of or dt.datetime.now()
        if period is not None and str(period).strip().lower() == "all":
            return cls.of_dates(None, None, as_of, open_end)
        given = [d for d in (from_date, to_date) if d is not None and str(d).strip()]
        if not given and default_today:
            today = as_of.date()
            return cls.of_dates(today, today, as_of, open_end)
        return cls.of_dates(from_date, to_date, as_of, open_end)

    @classmethod
    def preset(cls, name: str, as_of: dt.datetime | None = None) -> "TimeRange":
        """today / yesterday / last7 / last30 (inclusive of today)."""
        as_of = as_of or dt.datetime.now()
        today = as_of.date()
        key = name.strip().lower()
        if key == "today":
            return cls.of_dates(today, today, as_of)
        if key == "yesterday":
            y = today - dt.timedelta(days=1)
            return cls.of_dates(y, y, as_of)
        if key in ("last7", "last_7", "7d"):
            return cls.of_dates(today - dt.timedelta(days=6), today, as_of)
        if key in ("last30", "last_30", "30d"):
            return cls.of_dates(today - dt.timedelta(days=29), today, as_of)
        raise ValueError(f"unknown preset {name!r}")

    # -- use ----------------------------------------------------------------
    def predicate(self, col: Column | str = "captured_at") -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return (c >= ntz_literal(self.start)) & (c < ntz_literal(self.end))

    @property
    def start_date(self) -> dt.date:
        return self.start.date()

    @property
    def end_date_exclusive(self) -> dt.date:
        """First date not touched by the window (for date-grained tables)."""
        if self.end.time() == dt.time():
            return self.end.date()
        return self.end.date() + dt.timedelta(days=1)

    def sql(self, col: str = "captured_at") -> str:
        return (f"{col} >= TIMESTAMP '{self.start:%Y-%m-%d %H:%M:%S}' "
                f"AND {col} < TIMESTAMP '{self.end:%Y-%m-%d %H:%M:%S}'")
