"""railpulse: punctuality analytics for rail delay snapshots, built on Spark.

The library answers a fixed catalogue of punctuality questions (dashboard
totals, delay categories, hour-of-day profiles, station / route / destination /
train rankings, largest and most recent delays, daily counts) over a history
of delay snapshots and a trip dimension, maintains a daily station-and-route
metrics table by partition, and ingests landed live-departure payloads with a
stateful change-detection stream.

Every operator is a DataFrame transformation; nothing is collected to the
driver.  See ``railpulse.plans.registry`` for the named query catalogue.
"""

from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import ScopeFilter
from railpulse.session import get_spark

__all__ = ["TimeRange", "ScopeFilter", "get_spark"]
