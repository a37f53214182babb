from opsmetrics.operators import filters, volume
from opsmetrics.plans import fixtures as fx
from opsmetrics.plans.dashboard import dashboard
from tests.conftest import SF_SMALL, rows


def test_dashboard_views_use_the_filtered_frame(spark):
    ops = fx.operations(spark, SF_SMALL)
    views = dashboard(ops, years=[1996, 1997], tipos=["A", "M"], persist=True)
    filtered = filters.apply_filters(ops, years=[1996, 1997], tipos=["A", "M"])
    assert rows(views["owner_type_summary"]) == rows(volume.owner_type_summary(filtered))
    assert views["total_operations"].first()[0] == filtered.count()
    assert {r.tipo for r in views["allocation_guide"].collect()} <= {"A", "M"}
    # the forecast series cover every type: it runs on the unfiltered operations
    assert {r.serie for r in views["daily_series"].select("serie").distinct().collect()} > {"A", "M"}
    for name, df in views.items():
        df.limit(1).collect()
