"""All analyses of the dashboard pages over one filtered operations frame.

The filtered frame feeds every view. With ``persist=True`` it is kept
(memory and disk) for the views that follow; a lost block is recomputed from
its lineage. The forecast runs on the unfiltered operations, as the pages do.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from opsmetrics.functions.display import SESSION_LABELS, with_labels
from opsmetrics.operators import allocation, cycle, filters, forecast, loadlog, sessions, volume, workload


# What the views read of an operation.
VIEW_COLUMNS = ["file", "tipo", "operativo", "cliente", "estado", "fecha_file", "fecha_cierre"]


class Views(dict[str, DataFrame]):
    """Frames by view name; ``release`` frees what was persisted for them."""

    persisted: DataFrame | None = None

    def release(self) -> None:
        if self.persisted is not None:
            self.persisted.unpersist()
            self.persisted = None


def dashboard(
    ops: DataFrame,
    years: Iterable[int] | None = None,
    months: Iterable[str] | None = None,
    tipos: Iterable[str] | None = None,
    operativos: Iterable[str] | None = None,
    horizon: int = 90,
    persist: bool = False,
) -> Views:
    """Lazy frames of every operations page for the given global filters.

    With ``persist`` the columns that the views read are kept for all of them;
    call ``release`` on the result when the views are written.
    """
    ops = ops.select(*[c for c in VIEW_COLUMNS if c in ops.columns])
    filtered = filters.apply_filters(ops, years, months, tipos, operativos)
    if persist:
        filtered = filtered.persist(StorageLevel.MEMORY_AND_DISK)
    closed = filters.closed_durations(filtered)
    load = workload.open_load_by_owner(filtered)
    comparison = cycle.cycle_time_vs_standard(closed)
    flow = volume.flow_classification(filtered)
    daily = forecast.daily_series(ops)
    views = Views(
        {
            "filter_facets": filters.labelled_facets(filters.filter_facets(ops, years)),
            "monthly_volume": volume.monthly_volume(filtered),
            "type_distribution": volume.type_distribution(filtered),
            "owner_workload_top": volume.owner_workload(filtered),
            "allocation_guide": allocation.allocation_guide(filtered),
            "allocation_top": allocation.top_allocations(filtered),
            "open_load": load,
            "top_open_count": workload.top_open(load, "cantidad_operaciones"),
            "top_open_effort": workload.top_open(load, "esfuerzo_total"),
            "hidden_overload": workload.hidden_overload(load),
            "flow_classification": flow,
            "level_counts": volume.level_counts(flow),
            "owner_type_summary": volume.owner_type_summary(filtered),
            "total_operations": volume.total_operations(filtered),
            "cycle_vs_standard": comparison,
            "standard_vs_real_long": cycle.standard_vs_real_long(comparison),
            "owner_performance": cycle.owner_performance(closed),
            "bottleneck_causes": cycle.bottleneck_causes(cycle.slow_operations(closed)),
            "bottleneck_insight": cycle.bottleneck_insight(closed),
            "daily_series": daily,
            "forecast": forecast.forecast(daily, horizon),
        }
    )
    views.persisted = filtered if persist else None
    return views


def usage(user_sessions: DataFrame, as_of: dt.datetime, days: int = 30) -> Views:
    """The usage page: summary, per user, per day and the newest sessions."""
    return Views(
        {
            "session_summary": sessions.session_summary(user_sessions, as_of, days),
            "sessions_by_user": sessions.sessions_by_user(user_sessions, as_of, days),
            "sessions_by_day": sessions.sessions_by_day(user_sessions, as_of, days),
            "recent_sessions": with_labels(sessions.recent_sessions(user_sessions), SESSION_LABELS),
        }
    )


def loads(log: DataFrame) -> Views:
    """The load panel: totals, and the quality records of the newest load."""
    return Views({"load_log_kpis": loadlog.load_log_kpis(log), "latest_load_quality": loadlog.latest_load_quality(log)})
