"""Scalar column expressions (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railpulse.functions.constants import (
    BAND_LOW_BELOW, BAND_MEDIUM_BELOW, CATEGORIES, CATEGORY_LABELS, DELAYED_MIN,
    DUE_NOW_TEXT, UNKNOWN_ENDPOINT,
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round1(x) -> Column:
    """Half-up rounding to one decimal: floor(x * 10 + 0.5) / 10.

    Differs from ``round`` on negative halves (-2.25 -> -2.2).
    """
    return F.floor(_c(x).cast("double") * 10.0 + 0.5) / 10.0


def safe_ratio(num, den) -> Column:
    """num / den as double, 0.0 when den is not positive."""
    return F.when(_c(den) > 0, _c(num).cast("double") / _c(den)).otherwise(F.lit(0.0))


def delay_probability(delayed, total) -> Column:
    """Percentage of delayed among total, one decimal, 0 when total is 0."""
    return F.when(_c(total) > 0, round1(_c(delayed).cast("double") * 100.0 / _c(total))).otherwise(F.lit(0.0))


def reliability_band(probability) -> Column:
    p = _c(probability)
    return (F.when(p < BAND_LOW_BELOW, F.lit("low"))
            .when(p < BAND_MEDIUM_BELOW, F.lit("medium"))
            .otherwise(F.lit("high")))


def is_delayed(late, min_delay: int = DELAYED_MIN) -> Column:
    return _c(late) >= F.lit(min_delay)


def delay_category(late, early_as_on_time: bool = False) -> Column:
    """Category name of a lateness value.

    Negative values match no bucket and fall through to the open-ended
    category, as in the reference; ``early_as_on_time`` maps them to On Time.
    """
    v = _c(late)
    expr = None
    for name, lo, hi in CATEGORIES:
        cond = (v >= lo) if hi is None else v.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    last = CATEGORIES[-1][0]
    if early_as_on_time:
        expr = expr.when(v < 0, F.lit(CATEGORIES[0][0]))
    return expr.otherwise(F.lit(last))


def category_label(name) -> Column:
    n = _c(name)
    expr = None
    for (cat, _, _), label in zip(CATEGORIES, CATEGORY_LABELS):
        expr = F.when(n == cat, F.lit(label)) if expr is None else expr.when(n == cat, F.lit(label))
    return expr


def hour_label(hour) -> Column:
    return F.format_string("%02d:00", _c(hour))


def hhmm(ts) -> Column:
    """HH:mm of a wall-clock timestamp (zone-free field extraction)."""
    c = _c(ts)
    return F.when(c.isNotNull(), F.format_string("%02d:%02d", F.hour(c), F.minute(c)))


def hhmmss(ts) -> Column:
    c = _c(ts)
    return F.when(c.isNotNull(), F.format_string("%02d:%02d:%02d", F.hour(c), F.minute(c), F.second(c)))


def iso_date(ts) -> Column:
    """yyyy-MM-dd of a wall-clock timestamp (zone-free)."""
    return F.to_date(_c(ts)).cast("string")


def endpoint_or_unknown(col) -> Column:
    """COALESCE(NULLIF(x, ''), 'Unknown')."""
    c = _c(col)
    return F.when(c.isNull() | (c == F.lit("")), F.lit(UNKNOWN_ENDPOINT)).otherwise(c)


def non_empty(col) -> Column:
    c = _c(col)
    return c.isNotNull() & (c != F.lit(""))


def due_in_display(due_in) -> Column:
    d = _c(due_in)
    return F.when(d == 0, F.lit(DUE_NOW_TEXT)).otherwise(F.concat(d.cast("string"), F.lit(" min")))


def station_display_name(alias, desc) -> Column:
    a = _c(alias)
    return F.when(a.isNotNull() & (F.trim(a) != F.lit("")), a).otherwise(_c(desc))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def sum_if(cond: Column, value) -> Column:
    return F.sum(F.when(cond, _c(value)).otherwise(F.lit(0))).cast("long")
