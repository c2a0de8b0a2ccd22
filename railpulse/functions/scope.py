"""Service-scope resolution and the report filter variants.

A snapshot's scope is its stored ``service_scope``; when that is NULL it falls
back to HEUSTON if the station is HSTON or either trip endpoint mentions
Heuston, else CONNOLLY.

Because the fallback needs the trip's endpoints, the scoped reports classify a
snapshot *before* the trip join into one of three buckets:

* ``H`` – resolved HEUSTON without the trip (explicit scope, or NULL at HSTON);
* ``C`` – explicit CONNOLLY;
* ``U`` – NULL elsewhere: HEUSTON if the trip is Heuston-related, else CONNOLLY.

Any other non-NULL scope value is kept as is and never matches the two known
scopes.  Aggregating per (trip, bucket) lets the snapshot side be reduced
map-side before the shuffle; the trip's Heuston flag then decides bucket U.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from railpulse.functions.constants import (
    ALL_SCOPES, CONNOLLY, CONNOLLY_CODE, HEUSTON, HEUSTON_CODE, HEUSTON_TEXT,
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mentions_heuston(text) -> Column:
    """NULL-safe, case-insensitive 'contains heuston'."""
    return F.lower(F.coalesce(_c(text), F.lit(""))).contains(HEUSTON_TEXT)


def heuston_trip(origin="origin", destination="destination") -> Column:
    return mentions_heuston(origin) | mentions_heuston(destination)


def is_heuston_station(station_code="station_code") -> Column:
    return F.coalesce(F.upper(_c(station_code)) == F.lit(HEUSTON_CODE), F.lit(False))


def resolve_scope(service_scope="service_scope", station_code="station_code",
                  origin="origin", destination="destination", related: Column | None = None) -> Column:
    """O-P1 as one column expression (needs the trip endpoints, or whether they make it ``related`` to Heuston)."""
    related = heuston_trip(origin, destination) if related is None else related
    fallback = F.when(is_heuston_station(station_code) | related, F.lit(HEUSTON)).otherwise(F.lit(CONNOLLY))
    return F.coalesce(_c(service_scope), fallback)


def bucket_condition(bucket: str, service_scope="service_scope", station_code="station_code") -> Column:
    """Whether a snapshot is in a pre-join bucket, see module docstring (small
    predicates stay inside generated code)."""
    sc = _c(service_scope)
    hston = is_heuston_station(station_code)
    if bucket == "H":
        return (sc == F.lit(HEUSTON)) | (sc.isNull() & hston)
    if bucket == "C":
        return sc == F.lit(CONNOLLY)
    if bucket == "U":
        return sc.isNull() & ~hston
    return sc.isNotNull() & ~sc.isin(HEUSTON, CONNOLLY)


def scope_from_code(code: str | None) -> str | None:
    """HSTON/HEUSTON -> HEUSTON, CNLLY/CONNOLLY -> CONNOLLY, else None; any
    case, but no surrounding blanks."""
    if code is None:
        return None
    c = code.upper()
    if c in (HEUSTON_CODE, HEUSTON):
        return HEUSTON
    if c in (CONNOLLY_CODE, CONNOLLY):
        return CONNOLLY
    return None


def code_from_scope(scope: str | None) -> str:
    s = (scope or "").strip().upper()
    if s == HEUSTON:
        return HEUSTON_CODE
    if s == CONNOLLY:
        return CONNOLLY_CODE
    return "OVERVIEW"


@dataclass(frozen=True)
class ScopeFilter:
    """Which snapshots a report reads.

    ``network``  – all; ``stations`` – UPPER(station_code) in a list;
    ``station`` – one code, case-insensitive; ``scopes`` – resolved scope in a
    list; ``scope`` – one resolved scope.
    """

    kind: str = "network"
    values: tuple[str, ...] = ()

    @staticmethod
    def network() -> "ScopeFilter":
        return ScopeFilter("network")

    @staticmethod
    def stations(codes) -> "ScopeFilter":
        return ScopeFilter("stations", tuple(c.strip().upper() for c in codes))

    @staticmethod
    def station(code: str) -> "ScopeFilter":
        return ScopeFilter("station", (code.strip().upper(),))

    @staticmethod
    def scopes(scopes=ALL_SCOPES) -> "ScopeFilter":
        return ScopeFilter("scopes", tuple(scopes))

    @staticmethod
    def scope(code_or_scope: str | None) -> "ScopeFilter":
        """A station overview code or scope name; unknown falls back to CONNOLLY."""
        return ScopeFilter("scope", (scope_from_code(code_or_scope) or CONNOLLY,))

    # -- predicates -----------------------------------------------------------
    @property
    def is_scoped(self) -> bool:
        return self.kind in ("scopes", "scope")

    @property
    def scope_set(self) -> tuple[str, ...]:
        return self.values if self.is_scoped else ()

    def station_predicate(self, station_code="station_code") -> Column | None:
        if self.kind in ("stations", "station"):
            return F.upper(_c(station_code)).isin(list(self.values))
        return None

    def buckets(self) -> tuple[str, ...]:
        """Pre-join buckets that can contribute to the selected scopes."""
        out = []
        if HEUSTON in self.values:
            out.append("H")
        if CONNOLLY in self.values:
            out.append("C")
        if HEUSTON in self.values or CONNOLLY in self.values:
            out.append("U")
        return tuple(out)

    def row_selected(self, trip_is_heuston: Column, service_scope="service_scope",
                     station_code="station_code") -> Column:
        """Whether a snapshot row belongs to the selection, given its trip.

        The plan-time choices are folded here so the predicate stays small:
        explicit scopes compare directly; a NULL scope resolves to HEUSTON at
        HSTON, else by the trip's Heuston flag.
        """
        sc = _c(service_scope)
        heu, con = HEUSTON in self.values, CONNOLLY in self.values
        explicit = sc.isin(list(self.values))
        if heu and con:
            return explicit | sc.isNull()
        hston = is_heuston_station(station_code)
        if heu:
            return explicit | (sc.isNull() & (hston | trip_is_heuston))
        if con:
            return explicit | (sc.isNull() & ~hston & ~trip_is_heuston)
        return explicit

    def bucket_selected(self, bucket: str, trip_is_heuston: Column) -> Column:
        """Whether rows of ``bucket`` belong to the selection, given the trip."""
        if bucket == "H":
            return F.lit(HEUSTON in self.values)
        if bucket == "C":
            return F.lit(CONNOLLY in self.values)
        resolved = F.when(trip_is_heuston, F.lit(HEUSTON)).otherwise(F.lit(CONNOLLY))
        return resolved.isin(list(self.values))


def overview_code_col(scope) -> Column:
    """Column form of :func:`code_from_scope`."""
    u = F.upper(_c(scope))
    return (F.when(u == F.lit(HEUSTON), F.lit(HEUSTON_CODE))
            .when(u == F.lit(CONNOLLY), F.lit(CONNOLLY_CODE)).otherwise(F.lit("OVERVIEW")))
