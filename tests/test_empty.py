"""Every operator on empty input returns its schema, with the documented
exceptions (three zero levels, seven rule types, one active month)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsmetrics.operators import allocation, cycle, filters, forecast, ingest, loadlog, sessions, volume, workload
from opsmetrics.sources.sinks import to_contract

AS_OF = dt.datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def empty_ops(spark):
    base = spark.createDataFrame([("f", "A", "o", "c", "ABIERTO")], "file string, tipo string, operativo string, cliente string, estado string")
    return to_contract(base).where(F.lit(False))


def test_operations_empty(spark, empty_ops):
    closed = filters.closed_durations(empty_ops)
    zero_row = {
        "monthly": volume.monthly_volume(empty_ops),
        "types": volume.type_distribution(empty_ops),
        "owners": volume.owner_workload(empty_ops),
        "summary": volume.owner_type_summary(empty_ops),
        "flow": volume.flow_classification(empty_ops),
        "capacity": workload.available_capacity(empty_ops),
        "load": workload.open_load_by_owner(empty_ops),
        "hidden": workload.hidden_overload(workload.open_load_by_owner(empty_ops)),
        "facets": filters.filter_facets(empty_ops),
        "closed": closed,
        "performance": cycle.owner_performance(closed),
        "efficacy": cycle.owner_efficacy(closed),
        "speed": cycle.owner_speed(closed),
        "slow": cycle.slow_operations(closed),
        "causes": cycle.bottleneck_causes(cycle.slow_operations(closed)),
        "insight": cycle.bottleneck_insight(closed),
        "guide": allocation.allocation_guide(empty_ops),
        "daily": forecast.daily_series(empty_ops),
        "eligible": forecast.forecast_eligible(forecast.daily_series(empty_ops)),
        "forecast": forecast.forecast(forecast.daily_series(empty_ops)),
    }
    for name, df in zero_row.items():
        assert df.count() == 0, name
        assert len(df.columns) > 0, name
    assert volume.total_operations(empty_ops).first()[0] == 0
    assert volume.active_months(empty_ops).first()[0] == 1
    assert [r.cantidad for r in volume.level_counts(volume.flow_classification(empty_ops)).collect()] == [0, 0, 0]
    assert cycle.cycle_time_vs_standard(closed).count() == 7
    assert cycle.standard_vs_real_long(cycle.cycle_time_vs_standard(closed)).count() == 7


def test_upload_and_logs_empty(spark):
    raw = spark.createDataFrame([("x", "f")], "`Unnamed: 0` string, File string").where(F.lit(False))
    stored = spark.createDataFrame([], "file string")
    a = ingest.analyze_upload(raw.withColumn("_ordinal", F.lit(1)), stored)
    for df in (a.new, a.existing, a.duplicates, a.quality):
        assert df.count() == 0
    counts = a.counts.first()
    assert (counts.nuevos, counts.existentes, counts.duplicados) == (0, 0, 0)
    log = spark.createDataFrame([], "registros_limpios bigint, registros_duplicados bigint, calidad_json array<struct<campo:string,registros_faltantes:bigint,porcentaje:string>>, fecha_carga timestamp_ntz")
    assert loadlog.load_log_kpis(log).count() == 0
    assert loadlog.latest_load_quality(log).count() == 0


def test_sessions_empty(spark):
    ev = spark.createDataFrame([], "username string, ts timestamp_ntz, event_type string")
    s = sessions.sessionize(ev)
    assert s.count() == 0
    assert sessions.session_summary(s, AS_OF).count() == 0
    assert sessions.sessions_by_user(s, AS_OF).count() == 0
    assert sessions.sessions_by_day(s, AS_OF).count() == 0
    assert sessions.recent_sessions(s).count() == 0
