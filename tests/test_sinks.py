import json
import os

from pyspark.sql import functions as F

from opsmetrics.sources import append_sessions, export_csv, read_sessions
import datetime as dt


def test_export_csv_writes_nested_as_json(spark, tmpdir_path):
    df = spark.createDataFrame([("u1", ["a", "b"], 3)], "username string, pages array<string>, n int")
    path = f"{tmpdir_path}/report"
    export_csv(df, path, single_file=True)
    back = spark.read.options(header=True, escape='"').csv(path).collect()
    assert back[0].username == "u1" and json.loads(back[0].pages) == ["a", "b"] and back[0].n == "3"


def test_append_sessions_dead_letter(spark, tmpdir_path):
    df = spark.createDataFrame([("u1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1), 60, ["view"])],
                               "username string, session_start timestamp_ntz, session_end timestamp_ntz, duration_minutes bigint, pages_visited array<string>")
    good = f"{tmpdir_path}/sessions"
    assert append_sessions(df, good, f"{tmpdir_path}/dead") is True
    assert read_sessions(spark, good, since=dt.datetime(2023, 12, 31)).count() == 1
    assert read_sessions(spark, good, since=dt.datetime(2024, 1, 2)).count() == 0
    blocked = f"{tmpdir_path}/blocked"
    with open(blocked, "w") as fh:  # a plain file where the table folder should be
        fh.write("x")
    assert append_sessions(df, blocked, f"{tmpdir_path}/dead") is False
    dead = spark.read.json(f"{tmpdir_path}/dead").collect()
    assert len(dead) == 1 and dead[0].username == "u1" and dead[0].error


def test_read_operations_from_csv_coerces_dates_and_drops_missing_file_dates(spark, tmpdir_path):
    from opsmetrics.sources import read_load_log, read_operations

    path = f"{tmpdir_path}/ops.csv"
    with open(path, "w") as fh:
        fh.write("file,tipo,operativo,estado,fecha_file,fecha_cierre\n")
        fh.write("F1,A,o1,CERRADO,2024-01-02,2024-01-05 10:00:00\n")
        fh.write("F2,M,o2,ABIERTO,bad,\n")
        fh.write("F3,M,o2,ABIERTO,3/4/2024,\n")
    ops = read_operations(spark, path, fmt="csv", options={"header": "true"})
    got = sorted((r.file, r.fecha_file, r.fecha_cierre) for r in ops.collect())
    assert got == [("F1", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5, 10)), ("F3", dt.datetime(2024, 3, 4), None)]
    assert dict(ops.dtypes)["fecha_file"] == "timestamp_ntz"
    log_path = f"{tmpdir_path}/log"
    spark.createDataFrame(
        [(1, 0, dt.datetime(2024, 1, 1)), (2, 1, dt.datetime(2024, 3, 1)), (3, 0, dt.datetime(2024, 2, 1))],
        "registros_limpios bigint, registros_duplicados bigint, fecha_carga timestamp_ntz",
    ).write.parquet(log_path)
    assert [r.registros_limpios for r in read_load_log(spark, log_path).collect()] == [2, 3, 1]


def test_latest_load_tie_break(spark):
    from opsmetrics.operators import loadlog

    rec = "array<struct<campo:string,registros_faltantes:bigint,porcentaje:string>>"
    log = spark.createDataFrame(
        [(5, 1, [("Operativo", 1, "20.0%")], dt.datetime(2024, 3, 1)), (7, 2, [("Estado", 2, "28.6%")], dt.datetime(2024, 3, 1)),
         (9, 0, [], dt.datetime(2024, 1, 1))],
        f"registros_limpios bigint, registros_duplicados bigint, calidad_json {rec}, fecha_carga timestamp_ntz",
    )
    k = loadlog.load_log_kpis(log).first()
    assert (k.total_cargas, k.total_limpios, k.total_descartados, k.ultimos_limpios, k.ultimos_descartados) == (3, 21, 3, 7, 2)
    assert [(r.campo, r.registros_faltantes) for r in loadlog.latest_load_quality(log).collect()] == [("Estado", 2)]
