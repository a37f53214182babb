import datetime as dt

from pyspark.sql import functions as F

from opsmetrics.operators import allocation, cycle, filters, volume, workload
from tests.conftest import rows

D = dt.datetime
OPS_SCHEMA = "file string, tipo string, operativo string, cliente string, estado string, fecha_file timestamp_ntz, fecha_cierre timestamp_ntz"


def ops(spark, data):
    return spark.createDataFrame(data, OPS_SCHEMA)


def test_apply_filters_none_means_all_and_empty_means_nothing(spark):
    df = ops(spark, [
        ("f1", "A", "o1", None, None, D(1996, 3, 1), None),
        ("f2", "M", "o2", None, None, D(1996, 5, 1), None),
        ("f3", "A", None, None, None, D(1997, 3, 1), None),
        ("f4", "A", "o1", None, None, D(1998, 1, 1), None),
    ])
    assert filters.apply_filters(df).count() == 4
    assert rows(filters.apply_filters(df, years=[1996, 1997]), "file") == [("f1",), ("f2",), ("f3",)]
    assert rows(filters.apply_filters(df, years=[1996, 1997], months=["1996-03", "1997-03"]), "file") == [("f1",), ("f3",)]
    assert rows(filters.apply_filters(df, operativos=["o1"]), "file") == [("f1",), ("f4",)]  # NULL owner never matches
    assert rows(filters.apply_filters(df, months=["Marzo 1996", "marzo 1997"]), "file") == [("f1",), ("f3",)]
    for empty in ({"years": []}, {"months": []}, {"tipos": []}, {"operativos": []}):
        assert filters.apply_filters(df, **empty).count() == 0


def test_year_filter_reaches_the_scan(spark, tmpdir_path):
    path = f"{tmpdir_path}/ops"
    ops(spark, [("f1", "A", "o1", None, None, D(1996, 3, 1), None)]).write.parquet(path)
    plan = filters.apply_filters(spark.read.parquet(path), years=[1996])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fecha_file" in plan and "LessThan(fecha_file" in plan


def test_filter_facets(spark):
    df = ops(spark, [
        ("f1", "A", "o1", None, None, D(1996, 3, 1), None),
        ("f2", None, "o2", None, None, D(1997, 5, 1), None),
    ])
    assert rows(filters.filter_facets(df)) == sorted([
        ("anio", "1996"), ("anio", "1997"), ("mes", "1996-03"), ("mes", "1997-05"),
        ("operativo", "o1"), ("operativo", "o2"), ("tipo", "A"),
    ])
    assert ("mes", "1997-05") not in rows(filters.filter_facets(df, years=[1996]))


def test_closed_durations_drop_negative_and_keep_columns(spark):
    df = ops(spark, [
        ("f1", "A", "o1", "c", "CERRADO", D(2024, 1, 2), D(2024, 1, 1, 18)),  # -6 h -> -1 day, dropped
        ("f2", "A", "o1", "c", "ABIERTO", D(2024, 1, 1), D(2024, 1, 1, 2)),  # 0 days, kept (state ignored)
        ("f3", "A", "o1", "c", None, D(2024, 1, 1), None),
    ])
    out = filters.closed_durations(df)
    assert rows(out, "file", "duracion_real_dias") == [("f2", 0)]
    assert "cliente" in out.columns
    assert filters.closed_durations(df.drop("fecha_cierre")).count() == 0


def test_flow_classification_and_level_counts(spark):
    data = [(f"f{i}", "A", "o1", None, None, D(2024, 1 + i % 2, 1), None) for i in range(30)]
    data += [("g1", "Z", "o1", None, None, D(2024, 1, 1), None), ("g2", "A", None, None, None, D(2024, 1, 1), None)]
    out = volume.flow_classification(ops(spark, data))
    got = rows(out, "operativo", "tipo", "total_general", "promedio_mensual", "promedio_ideal", "indice_flujo", "nivel")
    assert got == [("o1", "A", 30, 15.0, 15.0, 100.0, "ALTO"), ("o1", "Z", 1, 0.5, 0.0, 0.0, "BAJO")]
    assert rows(volume.level_counts(out)) == [("ALTO", 1), ("BAJO", 1), ("MEDIO", 0)]
    empty = volume.flow_classification(ops(spark, data).where(F.lit(False)))
    assert rows(volume.level_counts(empty)) == [("ALTO", 0), ("BAJO", 0), ("MEDIO", 0)]
    assert volume.active_months(ops(spark, data).where(F.lit(False))).first()[0] == 1


def test_volume_summaries(spark):
    df = ops(spark, [
        ("f1", "A", "o1", None, None, D(2024, 1, 5), None),
        ("f2", "A", "o2", None, None, D(2024, 1, 6), None),
        (None, "M", "o2", None, None, D(2024, 2, 6), None),
        ("f4", None, "o3", None, None, D(2024, 2, 7), None),
    ])
    assert rows(volume.monthly_volume(df)) == [("2024-01", 2), ("2024-02", 1)]
    assert rows(volume.type_distribution(df)) == [("A", 2, 2 / 3), ("M", 1, 1 / 3)]
    assert rows(volume.owner_type_summary(df)) == [("o1", "A", 1), ("o2", "A", 1), ("o2", "M", 0)]
    assert volume.total_operations(df).first()[0] == 4
    assert volume.owner_workload(df, n=1).collect()[0].operativo == "o2"


def test_capacity_grid_open_rules_and_clip(spark):
    data = [(f"a{i}", "A", "o1", None, "ABIERTO", D(2024, 1, 1), None) for i in range(20)]
    data += [("m1", "M", "o2", None, None, D(2024, 1, 1), None),  # NULL state is open
             ("m2", "M", "o2", None, "Cerrado", D(2024, 1, 1), None),
             ("z1", "Z", None, None, None, D(2024, 1, 1), None)]  # NULL owner: not in the grid
    out = workload.available_capacity(ops(spark, data))
    assert rows(out) == [("o1", "A", 0), ("o1", "M", 10), ("o1", "Z", 0), ("o2", "A", 15), ("o2", "M", 9), ("o2", "Z", 0)]
    assert workload.available_capacity(ops(spark, data).drop("estado")).count() == 0


def test_open_load_hidden_overload(spark):
    data = []
    for owner, tipo, n in [("p1", "A", 6), ("p2", "M", 3), ("p3", "A", 5), ("p4", "A", 4), ("p5", "A", 4), ("p6", "A", 4), ("p7", "Z", 2)]:
        data += [(f"{owner}{i}", tipo, owner, None, "ABIERTO", D(2024, 1, 1), None) for i in range(n)]
    load = workload.open_load_by_owner(ops(spark, data))
    assert ("p7", 2, 2) in rows(load)  # unknown type weighs 1
    assert rows(workload.top_open(load, n=2), "operativo") == [("p1",), ("p3",)]
    assert rows(workload.hidden_overload(load)) == [("p2", 27)]


def _closed(spark, durations):
    data = [(f"f{i}", t, o, c, "CERRADO", D(2024, 1, 1), D(2024, 1, 1) + dt.timedelta(days=d)) for i, (t, o, c, d) in enumerate(durations)]
    return filters.closed_durations(ops(spark, data))


def test_cycle_time_vs_standard_always_seven_rows(spark):
    closed = _closed(spark, [("A", "o1", "c", 10), ("A", "o1", "c", 11), ("Z", "o1", "c", 5)])
    got = {r.tipo: r for r in cycle.cycle_time_vs_standard(closed).collect()}
    assert len(got) == 7 and got["A"].duracion_real_promedio == 10.5 and got["M"].duracion_real_promedio is None
    assert cycle.cycle_time_vs_standard(closed.where(F.lit(False))).count() == 7
    long = rows(cycle.standard_vs_real_long(cycle.cycle_time_vs_standard(closed)))
    assert len(long) == 8 and ("A", "duracion_real_promedio", 10.5) in long


def test_owner_performance_efficacy_speed(spark):
    closed = _closed(spark, [("A", "o1", "c", 10), ("A", "o1", "c", 40), ("Z", "o1", "c", 1), ("M", "o2", "c", 90)])
    assert rows(cycle.owner_performance(closed)) == [("o1", 17.0, 3, 1, 40), ("o2", 90.0, 1, 90, 90)]
    assert rows(cycle.owner_efficacy(closed)) == [("o1", "A", 50.0), ("o1", "Z", 0.0), ("o2", "M", 100.0)]
    assert rows(cycle.owner_speed(closed)) == [("o1", "A", 25.0), ("o1", "Z", 1.0), ("o2", "M", 90.0)]


def test_slow_operations_and_bottlenecks(spark):
    durations = [("A", f"o{i % 3}", f"c{i % 2}", i) for i in range(25)]
    closed = _closed(spark, durations)
    slow = cycle.slow_operations(closed)
    # quantile 0.8 of 0..24 is 19.2 -> 20..24 are slow
    assert rows(slow, "duracion_real_dias") == [(d,) for d in range(20, 25)]
    causes = rows(cycle.bottleneck_causes(slow))
    # o0 (21, 24) and o2 (20, 23) tie on count: the name decides
    assert ("operativo", "o0", 2, 1) in causes and ("operativo", "o2", 2, 2) in causes
    assert ("cliente", "c0", 3, 1) in causes and len(causes) == 6
    insight = cycle.bottleneck_insight(closed).collect()
    assert len(insight) == 1 and abs(insight[0].umbral - 19.2) < 1e-9 and insight[0].tipo == "A"
    few = _closed(spark, durations[:19])
    assert cycle.slow_operations(few).count() == 0
    assert cycle.bottleneck_insight(few).count() == 0


def test_allocation_guide_imputation_and_defaults(spark):
    data = [
        ("a1", "A", "o1", None, "CERRADO", D(2024, 1, 1), D(2024, 1, 11)),  # o1/A speed 10, success
        ("a2", "A", "o2", None, "ABIERTO", D(2024, 1, 1), None),
        ("m1", "M", "o2", None, "CERRADO", D(2024, 1, 1), D(2024, 4, 30)),  # o2/M speed 120 > 90: failure
    ]
    guide = {(r.operativo, r.tipo): r for r in allocation.allocation_guide(ops(spark, data)).collect()}
    # o2/A: no closed rows -> type mean of A over the grid rows (10.0), efficacy default 50
    assert guide[("o2", "A")].velocidad_promedio_dias == 10.0 and guide[("o2", "A")].eficacia_historica == 50.0
    assert guide[("o2", "A")].cargas_posibles_adicionales == 14
    assert guide[("o2", "A")].indice_estrategico == round(14 / 11 * 100 * 1.5, 2)
    # o1/M: type M mean over the grid rows is 120 (only o2 has one)
    assert guide[("o1", "M")].velocidad_promedio_dias == 120.0
    assert guide[("o2", "M")].eficacia_historica == 0.0
    top = allocation.allocation_top(allocation.allocation_guide(ops(spark, data), sort=False), n=1).collect()
    assert top[0].indice_estrategico == max(r.indice_estrategico for r in guide.values())


def test_allocation_guide_without_closed_rows_uses_90_days(spark):
    data = [("a1", "A", "o1", None, "ABIERTO", D(2024, 1, 1), None), ("m1", "M", "o2", None, None, D(2024, 1, 1), None)]
    got = allocation.allocation_guide(ops(spark, data)).collect()
    assert got and all(r.velocidad_promedio_dias == 90.0 and r.eficacia_historica == 50.0 for r in got)


def test_display_labels(spark):
    from opsmetrics.functions.display import ALLOCATION_LABELS, with_labels

    df = spark.createDataFrame([("A", "o1", 1)], "tipo string, operativo string, cargas_posibles_adicionales bigint")
    assert with_labels(df, ALLOCATION_LABELS).columns == ["Tipo", "Operativo", "Capacidad Disponible"]
