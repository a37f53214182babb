import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsmetrics import rules
from opsmetrics.operators import ingest
from opsmetrics.sources import append_load_log, append_operations, existing_keys, load_log_row, read_upload
from tests.conftest import rows

P = rules.PLACEHOLDER


def test_normalize_headers_maps_contract_names(spark):
    df = spark.createDataFrame(
        [("x", "1", "c", "2024-01-01", "v", "e", "s")],
        ["Unnamed: 0", "File", "NIT_Cliente", "Fch Primera Fact Prov", "Envío Facturar", "Fecha Cierre", "Otra Cosa!"],
    )
    out = ingest.normalize_headers(df)
    assert out.columns == ["file", "nit_cliente", "fecha_primera_factura", "envio_facturar", "fecha_cierre", "otracosa"]


def test_normalize_headers_drops_blank_csv_headers_and_rejects_collisions(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["_c0", "File", "file"])
    with pytest.raises(ValueError):
        ingest.normalize_headers(df)
    assert ingest.normalize_headers(spark.createDataFrame([("a", "b")], ["_c0", "Tipo"])).columns == ["tipo"]


def test_clean_text_adds_missing_columns(spark):
    df = spark.createDataFrame([(" f1 ", None), ("nan", " ab ")], "file string, tipo string")
    out = ingest.clean_text(df)
    assert set(out.columns) >= set(ingest.schema.TEXT_COLUMNS)
    got = rows(out, "file", "tipo", "operativo", "estado")
    assert got == [("F1", P, P, P), (P, "AB", P, P)]


def _upload(spark):
    data = [
        ("a", 3, "x"), ("A ", 1, "y"), (" a", 2, "z"),  # three copies of A; first by ordinal is 'y'
        ("b", 5, "x"), ("c", 4, "x"), ("c", 6, "w"),
        ("nan", 7, "x"), (None, 8, "x"),  # invalid keys
    ]
    df = spark.createDataFrame(data, "file string, _ordinal bigint, operativo string")
    return ingest.valid_rows(ingest.clean_text(df))


def test_duplicates_keep_every_copy(spark):
    got = rows(ingest.upload_duplicates(_upload(spark)), "file", "operativo")
    assert got == [("A", "X"), ("A", "Y"), ("A", "Z"), ("C", "W"), ("C", "X")]


def test_dedupe_keeps_first_by_ordinal(spark):
    got = rows(ingest.upload_dedupe(_upload(spark)), "file", "operativo")
    assert got == [("A", "Y"), ("B", "X"), ("C", "X")]


def test_split_partitions_the_deduped_rows(spark):
    deduped = ingest.upload_dedupe(_upload(spark))
    stored = existing_keys(spark.createDataFrame([(" a ",), ("",), (None,), ("zz",)], "file string"))
    new = ingest.split_new(deduped, stored)
    old = ingest.split_existing(deduped, stored)
    assert rows(new, "file") == [("B",), ("C",)]
    assert rows(old, "file") == [("A",)]
    assert sorted(rows(new, "file") + rows(old, "file")) == rows(deduped, "file")


def test_reingesting_gives_no_new_rows(spark):
    valid = _upload(spark)
    deduped = ingest.upload_dedupe(valid)
    assert ingest.split_new(deduped, existing_keys(deduped)).count() == 0


def test_quality_summary_values_and_empty(spark):
    new = spark.createDataFrame(
        [("F1", P, "C", "E"), ("F2", "O", P, P), ("F3", P, "C", "E"), ("F4", "O", "C", "E")],
        "file string, operativo string, comercial string, estado string",
    )
    got = rows(ingest.quality_summary(new))
    assert got == [("Comercial", 1, 25.0), ("Estado", 1, 25.0), ("Operativo", 2, 50.0)]
    assert ingest.quality_summary(new.where(F.lit(False))).count() == 0


def test_upload_counts_and_load_log_row(spark):
    valid = _upload(spark)  # keys A (3 copies), B, C (2 copies)
    stored = existing_keys(spark.createDataFrame([("a",), ("zz",)], "file string"))
    counts = ingest.upload_counts(valid, stored).collect()[0]
    assert (counts.nuevos, counts.existentes, counts.duplicados) == (2, 1, 5)
    new = ingest.split_new(ingest.upload_dedupe(valid), stored)
    summary = ingest.upload_summary(valid, stored)
    assert rows(ingest.summary_quality(summary)) == rows(ingest.quality_summary(new))
    row = load_log_row(summary, dt.datetime(2024, 5, 1)).collect()[0]
    assert (row.registros_limpios, row.registros_duplicados) == (2, 6)
    assert [(q.campo, q.registros_faltantes, q.porcentaje) for q in row.calidad_json] == [
        ("Operativo", 0, "0.0%"), ("Comercial", 2, "100.0%"), ("Estado", 2, "100.0%")
    ]
    assert row.fecha_carga == dt.datetime(2024, 5, 1)
    nothing_new = ingest.upload_summary(valid, valid.select("file"))
    assert load_log_row(nothing_new).collect()[0].calidad_json == []
    assert ingest.summary_quality(nothing_new).count() == 0
    none = ingest.upload_summary(valid.where(F.lit(False)), stored).first()
    assert (none.nuevos, none.existentes, none.duplicados, none.faltantes) == (0, 0, 0, [0, 0, 0])


def test_upload_roundtrip_through_csv_and_sinks(spark, tmpdir_path):
    csv_path = f"{tmpdir_path}/upload.csv"
    with open(csv_path, "w", encoding="utf-8") as fh:
        fh.write(",File,Tipo,Operativo,Comercial,Estado,Fecha File,Envío Facturar\n")
        fh.write("0, f1 ,a,op1,com1,abierto,1996-01-02,x\n")
        fh.write("1,F1,a,op2,com1,abierto,1996-01-03,x\n")
        fh.write("2,f2,m,,na,CERRADO,bad,x\n")
        fh.write("3,nan,m,op3,com1,abierto,1996-01-02,x\n")
    raw = read_upload(spark, csv_path)
    stored = spark.createDataFrame([("f2",)], "file string")
    result = ingest.analyze_upload(raw, stored, checkpoint=True)
    assert rows(result.new, "file", "operativo", "fecha_file") == [("F1", "OP1", dt.datetime(1996, 1, 2))]
    assert rows(result.existing, "file") == [("F2",)]
    assert result.duplicates.count() == 2
    target = f"{tmpdir_path}/ops"
    assert append_operations(result.new, target) == 1
    assert append_operations(result.new.where(F.lit(False)), target) == 0
    stored_now = spark.read.parquet(target)
    assert stored_now.columns == ingest.schema.CONTRACT_COLUMNS
    assert stored_now.count() == 1
    log_path = f"{tmpdir_path}/log"
    append_load_log(result.summary, log_path)
    log = spark.read.parquet(log_path).collect()
    assert (log[0].registros_limpios, log[0].registros_duplicados) == (1, 3)
    # the stored keys now include F1, so the same upload has no new rows
    again = ingest.analyze_upload(read_upload(spark, csv_path), spark.read.parquet(target).unionByName(stored, allowMissingColumns=True))
    assert again.new.count() == 0


def test_dedupe_without_ordinal_is_deterministic(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("b", "c")], "File string, Operativo string")
    stored = spark.createDataFrame([], "file string")
    for _ in range(2):
        got = sorted((r.file, r.operativo) for r in ingest.analyze_upload(df.repartition(3), stored).new.collect())
        assert got == [("A", "B"), ("B", "C")]


def test_read_upload_from_parquet_makes_text(spark, tmpdir_path):
    path = f"{tmpdir_path}/up.parquet"
    spark.createDataFrame([(1, dt.date(2024, 1, 2), 3.5)], "File int, `Fecha File` date, Monto double").write.parquet(path)
    up = read_upload(spark, path, fmt="parquet")
    assert dict(up.dtypes) == {"File": "string", "Fecha File": "string", "Monto": "string", "_ordinal": "bigint"}
    row = up.first()
    assert (row["File"], row["Fecha File"]) == ("1", "2024-01-02")
