"""Cross-report invariants on binding A (sf0.001)."""

from pyspark.sql import functions as F

from railpulse.functions.scope import ScopeFilter
from railpulse.operators import metrics as M
from railpulse.operators import reports as R
from railpulse.plans.registry import WHOLE
from railpulse.sources.bindings import TpchBinding

from .conftest import SMALL


def test_invariants(spark):
    a = TpchBinding(spark, SMALL)
    f = ScopeFilter.scopes()
    d = R.dashboard(a, WHOLE, f).first()
    cats = R.delay_categories(a, WHOLE, f).agg(F.sum("trips")).first()[0]
    assert d["delayed_trips"] == cats
    assert d["unique_trips"] == d["delayed_trips"] + d["on_time_trips"]
    hourly = R.hourly(a, WHOLE, f).agg(F.sum("total")).first()[0]
    assert hourly == d["total_snapshots"]
    m = M.build_daily_metrics(a, with_updated_at=False).where(F.col("service_scope").isin("CONNOLLY", "HEUSTON"))
    assert m.agg(F.sum("total_snapshots")).first()[0] == d["total_snapshots"]
    assert m.agg(F.sum("unique_trips")).first()[0] >= d["unique_trips"]
    routes = R.routes(a, WHOLE, f, limit=None).agg(F.sum("total_trips")).first()[0]
    assert routes <= d["unique_trips"]
    per_scope = sum(R.dashboard(a, WHOLE, ScopeFilter.scope(s)).first()["unique_trips"] for s in ("CNLLY", "HSTON"))
    assert per_scope >= d["unique_trips"]
