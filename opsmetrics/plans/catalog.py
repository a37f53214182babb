"""Registered queries: one Spark plan and (where SQL can state it) one DuckDB
oracle per key. Column names and rounding agree on both sides: doubles that the
operator does not round are rounded half-even to 6 decimals in both.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsmetrics import rules, schema
from opsmetrics.functions import quality_label, round_half_even, strip_all
from opsmetrics.functions.display import ALLOCATION_LABELS, with_labels
from opsmetrics.operators import allocation, cycle, filters, forecast, ingest, loadlog, sessions, volume, workload
from opsmetrics.plans import fixtures as fx
from opsmetrics.plans import oracle as o
from opsmetrics.session import checkpoint_dir
from opsmetrics.streaming import sessionize_cells_stream, sessionize_stream, start_event_split, start_sessions_sink
from opsmetrics.streaming.cells import LATE, STATE_STORE
from opsmetrics.sources.readers import (
    coerce_dates,
    existing_keys,
    read_load_log,
    read_operations,
    read_sessions,
    read_upload,
)
from opsmetrics.sources.sinks import append_operations, append_sessions, export_csv, load_log_row
from opsmetrics.sources.store import OperationsStore

Builder = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
AS_OF = dt.datetime(2024, 1, 31)
SUMMARY_DAYS = 30
USAGE_DAYS = (7, 15, 60, 90)
FILTER_YEARS = [1996, 1997]
FILTER_MONTHS = ["1996-03", "1996-04"]
FILTER_TYPES = ["A", "M", "Z"]
FILTER_OWNERS = [f"OP{i:05d}" for i in range(100)]
STORE_BUCKETS = 16
OFF_TIES = 0.0000123
UPLOAD_COLUMNS = ["file", "cliente", "tipo", "operativo", "comercial", "estado"]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: round_half_even(c, 6) for c in cols})


# ---------------------------------------------------------------- fixtures ---
def _ops(spark, sf):
    return fx.operations(spark, sf)


def _narrow(spark, sf):
    return fx.operations(spark, sf, narrow=True)


def _closed(spark, sf):
    return filters.closed_durations(_ops(spark, sf))


def _upload(spark, sf):
    return ingest.analyze_upload(fx.raw_upload(spark, sf), fx.existing_ops(spark, sf))


def _valid_upload(spark, sf):
    return ingest.valid_rows(ingest.clean_text(ingest.normalize_headers(fx.raw_upload(spark, sf))))


OPS = o.ops_cte()
NARROW = o.ops_cte(narrow=True)
UPLOAD = [o.RAW_UPLOAD_CTE, o.UPLOAD_CLEAN_CTE]
UPCOLS = ", ".join(UPLOAD_COLUMNS)
CLOSED_COLS = "file, operativo, tipo, cliente, duracion_real_dias"
IDEAL_SQL = o.case_map("tipo", rules.IDEAL_PER_MONTH, rules.DEFAULT_IDEAL)
EFFORT_SQL = o.case_map("tipo", rules.EFFORT_POINTS, rules.DEFAULT_EFFORT)
STD_SQL = o.case_map("tipo", rules.STANDARD_DAYS)

FLOW_SQL_CTES = [
    NARROW,
    "m AS (SELECT greatest(count(DISTINCT strftime(fecha_file, '%Y-%m')), 1) AS meses FROM ops)",
    "g AS (SELECT operativo, tipo, count(file) AS total_general FROM ops "
    "WHERE operativo IS NOT NULL AND tipo IS NOT NULL GROUP BY 1, 2)",
    f"c AS (SELECT *, total_general / (SELECT meses FROM m) AS promedio_mensual, "
    f"CAST({IDEAL_SQL} AS DOUBLE) AS promedio_ideal FROM g)",
    "i AS (SELECT *, coalesce(promedio_mensual / nullif(promedio_ideal, 0) * 100, 0) AS indice_flujo, "
    "CASE WHEN coalesce(promedio_mensual / nullif(promedio_ideal, 0) * 100, 0) < 70 THEN 'BAJO' "
    "WHEN coalesce(promedio_mensual / nullif(promedio_ideal, 0) * 100, 0) < 100 THEN 'MEDIO' ELSE 'ALTO' END AS nivel FROM c)",
]

CAPACITY_SQL_CTES = [
    OPS,
    "owners AS (SELECT DISTINCT operativo FROM ops WHERE operativo IS NOT NULL)",
    "types AS (SELECT DISTINCT tipo FROM ops WHERE tipo IS NOT NULL)",
    f"opn AS (SELECT operativo, tipo, count(file) AS n FROM ops WHERE {o.OPEN} "
    "AND operativo IS NOT NULL AND tipo IS NOT NULL GROUP BY 1, 2)",
    f"cap AS (SELECT w.operativo, t.tipo, CAST(greatest({o.case_map('t.tipo', rules.IDEAL_PER_MONTH, rules.DEFAULT_IDEAL)} "
    "- coalesce(opn.n, 0), 0) AS BIGINT) AS cargas_posibles_adicionales "
    "FROM owners w CROSS JOIN types t LEFT JOIN opn ON opn.operativo = w.operativo AND opn.tipo = t.tipo)",
]

OPEN_LOAD_CTE = (
    f"l AS (SELECT operativo, count(file) AS cantidad_operaciones, CAST(sum({EFFORT_SQL}) AS BIGINT) AS esfuerzo_total "
    f"FROM ops WHERE {o.OPEN} AND operativo IS NOT NULL GROUP BY 1)"
)

GUIDE_SQL_CTES = CAPACITY_SQL_CTES + [
    o.CLOSED_CTE,
    "perf AS (SELECT operativo, tipo, avg(duracion_real_dias) AS vel, "
    f"round_even(avg(CASE WHEN coalesce(duracion_real_dias <= {STD_SQL}, false) THEN 1.0 ELSE 0.0 END)::DOUBLE * 100, 1) AS ef "
    "FROM closed WHERE operativo IS NOT NULL AND tipo IS NOT NULL GROUP BY 1, 2)",
    "g AS (SELECT cap.*, perf.vel, perf.ef FROM cap LEFT JOIN perf USING (operativo, tipo))",
    "g1 AS (SELECT *, coalesce(vel, round_even(avg(vel) OVER (PARTITION BY tipo), 9)) AS vel1 FROM g)",
    "g2 AS (SELECT *, coalesce(vel1, round_even((SELECT avg(vel1) FROM g1), 9), 90.0)::DOUBLE AS velocidad, coalesce(ef, 50.0)::DOUBLE AS eficacia FROM g1)",
    "guide AS (SELECT tipo, operativo, cargas_posibles_adicionales, velocidad AS velocidad_promedio_dias, "
    "eficacia AS eficacia_historica, "
    "round_even((cargas_posibles_adicionales / (velocidad + 1)) * 100 * (1 + eficacia / 100), 2) AS indice_estrategico "
    "FROM g2 WHERE cargas_posibles_adicionales > 0)",
]
GUIDE_SELECT = (
    "SELECT tipo, operativo, cargas_posibles_adicionales, round_even(velocidad_promedio_dias, 6) AS velocidad_promedio_dias, "
    "round_even(eficacia_historica, 6) AS eficacia_historica, indice_estrategico FROM guide"
)

SLOW_CTES = [
    OPS,
    o.CLOSED_CTE,
    "st AS (SELECT quantile_cont(duracion_real_dias, 0.8) AS thr, count(*) AS n FROM closed)",
    "slow AS (SELECT closed.* FROM closed, st WHERE duracion_real_dias > thr AND n >= 20)",
    "u AS (SELECT 'tipo' AS dimension, tipo AS valor FROM slow UNION ALL SELECT 'operativo', operativo FROM slow "
    "UNION ALL SELECT 'cliente', cliente FROM slow)",
    "cnt AS (SELECT dimension, valor, count(*) AS operaciones FROM u WHERE valor IS NOT NULL GROUP BY 1, 2)",
    "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY operaciones DESC, valor ASC) AS BIGINT) AS posicion FROM cnt)",
]

CMP_CTES = [
    OPS,
    o.CLOSED_CTE,
    "ref AS "
    + o.values_table(
        [(t, rules.STANDARD_DAYS[t], rules.TARGET_DAYS[t]) for t in rules.STANDARD_DAYS],
        ["tipo", "tiempo_estandar", "meta_mejora"],
    ),
    "obs AS (SELECT tipo, avg(duracion_real_dias) AS m FROM closed GROUP BY tipo)",
    "cmp AS (SELECT ref.tipo, CAST(tiempo_estandar AS BIGINT) AS tiempo_estandar, CAST(meta_mejora AS BIGINT) AS meta_mejora, "
    "round_even(obs.m, 1) AS duracion_real_promedio FROM ref LEFT JOIN obs ON ref.tipo = obs.tipo)",
]

DAILY_CTE = (
    "daily AS (SELECT tipo AS serie, CAST(fecha_file AS DATE) AS ds, count(*) AS y FROM ops "
    f"WHERE tipo <> '{rules.ALL_SERIES}' GROUP BY 1, 2 "
    f"UNION ALL SELECT '{rules.ALL_SERIES}' AS serie, CAST(fecha_file AS DATE) AS ds, count(*) AS y FROM ops GROUP BY 2)"
)

STREAM_GAP, STREAM_WATERMARK = "6 hours", "1 hour"
SESSION_OUT = ["username", "session_start", "session_end", "duration_minutes"]


def _io_path(spark: SparkSession, name: str) -> str:
    """A new place for a query that writes and reads back, in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/opsmetrics-{name}/{uuid.uuid4().hex}"


def _stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 end to end: the events file as a file stream, watermarked session
    windows, the idempotent foreachBatch sink, ``availableNow``. Output and
    stream checkpoint live under the session's checkpoint folder. Returns the
    sessions the watermark has closed, read back as a batch frame. The stream
    runs while the query is built, as a stream is an action; any failed batch is
    an error here, also one whose rows went to the dead letters."""
    base = _io_path(spark, "stream")
    events_path = f"{sf_dir.rstrip('/')}/events.parquet"
    given = spark.read.parquet(events_path)
    reader = spark.readStream.schema(given.schema)
    files = given.inputFiles()
    if len(files) != 1 or not files[0].endswith("/events.parquet"):  # a folder of part files streams as is
        source = reader.parquet(events_path)
    else:  # a single file: stream its folder, keeping only that file
        source = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = source.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), "ts", "event_type"
    )
    stream = sessionize_stream(events, gap=STREAM_GAP, watermark=STREAM_WATERMARK)
    query = start_sessions_sink(stream, f"{base}/out", f"{base}/dead", f"{base}/checkpoint")
    query.awaitTermination()  # raises what ended the stream, if anything did
    if query.dead_letters:
        raise RuntimeError(f"batches in the dead letters {base}/dead: {query.dead_letters}")
    # every stream with events writes at least one batch folder; one without any writes none
    out = spark.read.parquet(f"{base}/out") if query.lastProgress else spark.createDataFrame([], schema.SESSIONS)
    return out.select(*SESSION_OUT, F.array_join("pages_visited", ",").alias("pages"))


def _stream_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 in two levels of state, over the events written as a folder."""
    base = _io_path(spark, "cells")
    events = fx.events_with_user(spark, sf_dir)
    events.write.parquet(f"{base}/in")
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        stream = sessionize_cells_stream(spark.readStream.schema(events.schema).parquet(f"{base}/in"), STREAM_GAP, STREAM_WATERMARK)
        query = start_sessions_sink(stream, f"{base}/out", f"{base}/dead", f"{base}/checkpoint")
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    if query.dead_letters:
        raise RuntimeError(f"batches in the dead letters {base}/dead: {query.dead_letters}")
    out = spark.read.parquet(f"{base}/out") if query.lastProgress else spark.createDataFrame([], schema.SESSIONS)
    return out.select(*SESSION_OUT, F.array_join("pages_visited", ",").alias("pages"))


def _stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with why it is in the side sink, if it is: one event in five arrives after all others."""
    base = _io_path(spark, "split")
    events = fx.events_with_user(spark, sf_dir)
    second = F.pmod(F.minute("ts"), F.lit(5)) == 0
    for arrival in (~second, second):
        events.where(F.coalesce(arrival, F.lit(False))).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        start_event_split(source, f"{base}/accepted", f"{base}/late", f"{base}/checkpoint", STREAM_WATERMARK).awaitTermination()
    columns = ["username", "ts", "event_type"]
    taken = spark.read.parquet(f"{base}/accepted").select(*columns, F.lit(None).cast("string").alias("motivo"))
    return taken.unionByName(spark.read.parquet(f"{base}/late").select(*columns, "motivo"))


def _ops_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: stored operations whose dates are text, one in seven of them unreadable."""
    path = _io_path(spark, "operations")
    ops = _ops(spark, sf_dir)
    number = F.substring("file", 2, 9).cast("long")
    text = F.when(F.pmod(number, F.lit(7)) == 0, F.lit("sin fecha")).otherwise(F.date_format("fecha_file", "d/M/yyyy"))
    ops.withColumn("fecha_file", text).withColumn("fecha_cierre", F.col("fecha_cierre").cast("string")).write.parquet(path)
    return read_operations(spark, path, day_first=True).select("file", "tipo", "operativo", "fecha_file", "fecha_cierre", "estado")


def _append_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6: two appends; the written counts are the observed ones."""
    path = _io_path(spark, "append")
    ops = _ops(spark, sf_dir)
    first = append_operations(ops.where("estado is null"), path)
    second = append_operations(ops.where("estado is not null"), path)
    return read_operations(spark, path).agg(
        F.lit(first).cast("long").alias("primera"),
        F.lit(second).cast("long").alias("segunda"),
        F.count(F.lit(1)).alias("filas"),
        F.countDistinct("file").alias("claves"),
    )


def _stored(spark: SparkSession, sf_dir: str) -> OperationsStore:
    """The stored keys of the fixture as a store: half of them in the index, half in a later load."""
    store = OperationsStore(spark, _io_path(spark, "store"))
    stored = fx.existing_ops(spark, sf_dir)
    early = F.pmod(F.xxhash64("file"), F.lit(2)) == 0
    store.commit(store.begin(stored.where(early)))
    store.refresh_index(STORE_BUCKETS)
    store.commit(store.begin(stored.where(~early)))
    return store


def _store_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 and J4 through the key index: each upload row with whether its key is stored."""
    upload = ingest.analyze_upload(fx.raw_upload(spark, sf_dir), _stored(spark, sf_dir))
    flagged = [part.select(*UPLOAD_COLUMNS, F.lit(known).alias("almacenada")) for part, known in ((upload.new, False), (upload.existing, True))]
    return flagged[0].unionByName(flagged[1])


def _store_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 by commits: two loads of one upload at once, and one that never commits; each key is stored once."""
    store = _stored(spark, sf_dir)
    path = _io_path(spark, "load")
    ingest.upload_dedupe(_valid_upload(spark, sf_dir)).drop("_ordinal").write.parquet(path)
    rows = spark.read.parquet(path)
    first, second = store.begin(rows.where("tipo <> 'C'")), store.begin(rows.where("tipo <> 'A'"))
    store.begin(rows)
    store.commit(second)
    store.commit(first)
    return store.read().select(F.upper(strip_all("file")).alias("file"), "tipo", "operativo")


def _upload_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _io_path(spark, "upload")
    export_csv(fx.awkward_upload(spark, sf_dir), path)
    return read_upload(spark, path).drop("_ordinal")


def _export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, read back with the plain reader and the quoting that spreadsheets use."""
    path = _io_path(spark, "export")
    export_csv(fx.awkward_upload(spark, sf_dir), path)
    return spark.read.csv(path, header=True, escape='"', multiLine=True)


def _load_log_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _io_path(spark, "loads")
    fx.load_log(spark, sf_dir).write.parquet(path)
    return read_load_log(spark, path).select("fecha_carga", "registros_limpios", "registros_duplicados")


def _sessions_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 and S5: appended sessions, read back from a day on."""
    path = _io_path(spark, "sessions")
    if not append_sessions(fx.sessions(spark, sf_dir), path, f"{path}-dead"):
        raise RuntimeError(f"the sessions went to the dead letters {path}-dead")
    return read_sessions(spark, path, since=AS_OF - dt.timedelta(days=SUMMARY_DAYS)).select(*SESSION_OUT)


def _sessions_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8: a sink that cannot be written; the rows and the error text are kept."""
    path = _io_path(spark, "dead")
    append_sessions(fx.sessions(spark, sf_dir), path, f"{path}-dead", fmt="no_such_format")
    dead = spark.read.json(f"{path}-dead")
    return dead.select("username", "duration_minutes", F.contains("error", F.lit("no_such_format")).alias("con_error"))


def _forecast_equations(ops: DataFrame) -> DataFrame:
    daily = forecast.daily_series(ops)
    equations = forecast.normal_equations(daily, forecast.series_frame(daily))
    # three digits, as sums of thousands of sines depend on their order, and moved off the ties of exact fractions
    return equations.withColumn("valor", round_half_even(F.col("valor") + F.lit(OFF_TIES), 3) + F.lit(0.0))


def _forecast_checks(ops: DataFrame) -> DataFrame:
    """What must hold of each fitted series, whatever the fit."""
    fitted = forecast.forecast(forecast.daily_series(ops))
    order = Window.partitionBy("serie").orderBy("ds")
    width = F.col("yhat_upper") - F.col("yhat_lower")
    past = F.col("nth") > F.col("n") - rules.FORECAST_HORIZON_DAYS
    rows = fitted.withColumns(
        {
            "narrower": width < F.lag(width).over(order) - 1e-9,
            "nth": F.row_number().over(order),
            "n": F.count(F.lit(1)).over(Window.partitionBy("serie")),
        }
    )
    inside = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    parts = F.col("trend") + F.col("weekly") + F.col("yearly")
    return rows.groupBy("serie").agg(
        F.count(F.lit(1)).alias("filas"),
        F.min("ds").alias("primer_dia"),
        F.max("ds").alias("ultimo_dia"),
        F.count_if(inside).alias("en_banda"),
        F.count_if(F.abs(F.col("yhat") - parts) <= 1e-6 * F.greatest(F.abs("yhat"), F.lit(1.0))).alias("aditivas"),
        F.count_if(past & F.col("narrower")).alias("mas_estrechas"),
    )


SINCE = f"TIMESTAMP '{(AS_OF - dt.timedelta(days=SUMMARY_DAYS)).isoformat(sep=' ')}'"


def _spark_queries() -> dict[str, Builder]:
    q: dict[str, Builder] = {}

    # sources
    q["ops_load"] = lambda s, d: _ops(s, d).select("file", "tipo", "operativo", "fecha_file", "fecha_cierre", "estado")
    q["existing_keys"] = lambda s, d: existing_keys(fx.existing_ops(s, d))

    # ingestion
    q["ingest_headers"] = lambda s, d: ingest.normalize_headers(fx.raw_upload(s, d)).select(
        "file", "nit_cliente", "cliente", "fecha_primera_factura", "envio_facturar"
    )
    q["ingest_clean"] = lambda s, d: ingest.clean_text(ingest.normalize_headers(fx.raw_upload(s, d))).select(
        *schema.TEXT_COLUMNS
    )
    q["ingest_dates"] = lambda s, d: coerce_dates(
        ingest.clean_text(ingest.normalize_headers(fx.raw_upload(s, d)))
    ).select("file", "fecha_file", "fecha_cierre", "fecha_primera_factura")
    q["ingest_duplicates"] = lambda s, d: ingest.upload_duplicates(_valid_upload(s, d)).select(*UPLOAD_COLUMNS)
    q["ingest_dedupe"] = lambda s, d: ingest.upload_dedupe(_valid_upload(s, d)).select(*UPLOAD_COLUMNS)
    q["ingest_existing"] = lambda s, d: _upload(s, d).existing.select(*UPLOAD_COLUMNS)
    q["ingest_new"] = lambda s, d: _upload(s, d).new.select(*UPLOAD_COLUMNS)
    q["quality_summary"] = lambda s, d: r6(_upload(s, d).quality, "porcentaje")

    def _log_entry(s, d):
        a = _upload(s, d)
        record = lambda r: F.concat_ws(":", r["campo"], r["registros_faltantes"].cast("string"), r["porcentaje"])
        return load_log_row(a.summary).select(
            "registros_limpios", "registros_duplicados", F.array_join(F.transform("calidad_json", record), ",").alias("calidad")
        )

    q["load_log_entry"] = _log_entry
    q["load_log_kpis"] = lambda s, d: loadlog.load_log_kpis(fx.load_log(s, d))
    q["latest_load_quality"] = lambda s, d: loadlog.latest_load_quality(fx.load_log(s, d))

    q["upload_bad_dates"] = lambda s, d: _upload(s, d).bad_dates

    # sources and sinks, written to the shared folder and read back
    q["ops_read"] = _ops_read
    q["append_operations"] = _append_operations
    q["store_split"] = _store_split
    q["store_loads"] = _store_loads
    q["upload_csv_roundtrip"] = _upload_csv
    q["export_csv_roundtrip"] = _export_csv
    q["load_log_read"] = _load_log_read
    q["sessions_since"] = _sessions_since
    q["sessions_dead_letter"] = _sessions_dead_letter

    # filters
    q["filter_facets_years"] = lambda s, d: filters.labelled_facets(filters.filter_facets(_ops(s, d), FILTER_YEARS))
    q["filter_global"] = lambda s, d: filters.apply_filters(
        _ops(s, d), FILTER_YEARS, FILTER_MONTHS, FILTER_TYPES, FILTER_OWNERS
    ).select("file", "tipo", "operativo", "fecha_file")
    q["filter_facets"] = lambda s, d: filters.filter_facets(_ops(s, d))
    q["open_ops"] = lambda s, d: filters.open_operations(_ops(s, d)).select("file", "operativo", "tipo", "estado")
    q["closed_durations"] = lambda s, d: _closed(s, d).select("file", "operativo", "tipo", "cliente", "duracion_real_dias")

    # volume and classification
    q["monthly_volume"] = lambda s, d: volume.monthly_volume(_ops(s, d))
    q["type_distribution"] = lambda s, d: r6(volume.type_distribution(_ops(s, d)), "proporcion")
    q["owner_workload_top"] = lambda s, d: volume.owner_workload(_ops(s, d))
    q["owner_type_summary"] = lambda s, d: volume.owner_type_summary(_ops(s, d))
    q["total_operations"] = lambda s, d: volume.total_operations(_ops(s, d))
    q["active_months"] = lambda s, d: volume.active_months(_ops(s, d))
    q["flow_classification"] = lambda s, d: r6(
        volume.flow_classification(_narrow(s, d)), "promedio_mensual", "promedio_ideal", "indice_flujo"
    )
    q["level_counts"] = lambda s, d: volume.level_counts(volume.flow_classification(_narrow(s, d)))

    # workload and capacity
    q["available_capacity"] = lambda s, d: workload.available_capacity(_ops(s, d))
    q["open_load"] = lambda s, d: workload.open_load_by_owner(_ops(s, d))
    q["top_open_count"] = lambda s, d: workload.top_open(workload.open_load_by_owner(_ops(s, d)), "cantidad_operaciones")
    q["top_open_effort"] = lambda s, d: workload.top_open(workload.open_load_by_owner(_ops(s, d)), "esfuerzo_total")
    q["hidden_overload"] = lambda s, d: workload.hidden_overload(workload.open_load_by_owner(_ops(s, d)))

    # cycle times and bottlenecks
    q["cycle_vs_standard"] = lambda s, d: cycle.cycle_time_vs_standard(_closed(s, d))
    q["standard_vs_real_long"] = lambda s, d: cycle.standard_vs_real_long(cycle.cycle_time_vs_standard(_closed(s, d)))
    q["owner_performance"] = lambda s, d: cycle.owner_performance(_closed(s, d))
    q["owner_efficacy"] = lambda s, d: cycle.owner_efficacy(_closed(s, d))
    q["owner_speed"] = lambda s, d: r6(cycle.owner_speed(_closed(s, d)), "velocidad_promedio_dias")
    q["slow_operations"] = lambda s, d: cycle.slow_operations(_closed(s, d)).select(
        "file", "operativo", "tipo", "cliente", "duracion_real_dias"
    )
    q["bottleneck_causes"] = lambda s, d: cycle.bottleneck_causes(cycle.slow_operations(_closed(s, d)))
    q["bottleneck_insight"] = lambda s, d: r6(cycle.bottleneck_insight(_closed(s, d)), "umbral")

    # allocation
    q["allocation_guide"] = lambda s, d: r6(
        allocation.allocation_guide(_ops(s, d)), "velocidad_promedio_dias", "eficacia_historica"
    )
    q["allocation_top"] = lambda s, d: r6(
        allocation.top_allocations(_ops(s, d)),
        "velocidad_promedio_dias",
        "eficacia_historica",
    )

    q["allocation_top_labelled"] = lambda s, d: with_labels(q["allocation_top"](s, d), ALLOCATION_LABELS)

    # forecast
    q["daily_series"] = lambda s, d: forecast.daily_series(_ops(s, d))
    q["forecast_eligible"] = lambda s, d: forecast.forecast_eligible(forecast.daily_series(_ops(s, d)))
    q["forecast"] = lambda s, d: forecast.forecast(forecast.daily_series(_ops(s, d)))

    q["forecast_equations"] = lambda s, d: _forecast_equations(_ops(s, d))
    q["forecast_checks"] = lambda s, d: _forecast_checks(_ops(s, d))

    # sessions
    q["sessionize"] = lambda s, d: fx.sessions(s, d).select(
        "username", "session_start", "session_end", "duration_minutes", F.array_join("pages_visited", ",").alias("pages")
    )
    q["session_summary"] = lambda s, d: r6(
        sessions.session_summary(fx.sessions(s, d), AS_OF, SUMMARY_DAYS), "avg_duration_minutes", "total_hours"
    )
    for days in USAGE_DAYS:
        q[f"session_summary_{days}"] = lambda s, d, days=days: r6(
            sessions.session_summary(fx.sessions(s, d), AS_OF, days), "avg_duration_minutes", "total_hours"
        )
    q["sessions_by_user"] = lambda s, d: sessions.sessions_by_user(fx.sessions(s, d), AS_OF, SUMMARY_DAYS)
    q["sessions_by_day"] = lambda s, d: sessions.sessions_by_day(fx.sessions(s, d), AS_OF, SUMMARY_DAYS)
    q["recent_sessions"] = lambda s, d: sessions.recent_sessions(fx.sessions(s, d))
    q["session_summary_periods"] = lambda s, d: r6(
        sessions.session_summaries(fx.sessions(s, d), AS_OF), "avg_duration_minutes", "total_hours"
    )
    q["sessionize_stream"] = _stream_sessions
    q["sessionize_stream_cells"] = _stream_cells
    q["stream_event_split"] = _stream_split
    return q


def _oracle() -> dict[str, str]:
    w = o.with_
    sql: dict[str, str] = {}
    sql["ops_load"] = w(OPS) + "SELECT file, tipo, operativo, fecha_file, fecha_cierre, estado FROM ops"
    sql["existing_keys"] = w(*UPLOAD) + "SELECT file FROM existing_keys"
    sql["ingest_headers"] = w(o.RAW_UPLOAD_CTE) + (
        'SELECT "File" AS file, "NIT_Cliente" AS nit_cliente, "Cliente" AS cliente, '
        '"Fch Primera Fact Prov" AS fecha_primera_factura, "Envío Facturar" AS envio_facturar FROM raw_upload'
    )
    sql["ingest_clean"] = w(*UPLOAD) + (
        "SELECT file, nit_cliente, cliente, tipo, operativo, comercial, envio_facturar, estado FROM upload_clean"
    )
    sql["ingest_dates"] = w(*UPLOAD) + "SELECT file, fecha_file, fecha_cierre, fecha_primera_factura FROM upload_clean"
    sql["ingest_duplicates"] = w(*UPLOAD) + f"SELECT {UPCOLS} FROM upload_duplicates"
    sql["ingest_dedupe"] = w(*UPLOAD) + f"SELECT {UPCOLS} FROM upload_dedupe"
    sql["ingest_existing"] = w(*UPLOAD) + f"SELECT {UPCOLS} FROM upload_existing"
    sql["ingest_new"] = w(*UPLOAD) + f"SELECT {UPCOLS} FROM upload_new"
    quality_parts = " UNION ALL ".join(
        f"SELECT '{f.title()}' AS campo, count(*) FILTER (WHERE {f} = '{rules.PLACEHOLDER}') AS registros_faltantes, "
        f"count(*) AS total FROM upload_new"
        for f in rules.QUALITY_FIELDS
    )
    quality_order = " UNION ALL ".join(
        f"SELECT {pos} AS pos, '{quality_label(f)}' AS campo, count(*) FILTER (WHERE {f} = '{rules.PLACEHOLDER}') AS registros_faltantes, "
        "count(*) AS total FROM upload_new"
        for pos, f in enumerate(rules.QUALITY_FIELDS)
    )
    sql["quality_summary"] = w(*UPLOAD) + (
        f"SELECT campo, registros_faltantes, round_even(registros_faltantes / total * 100, 6) AS porcentaje "
        f"FROM ({quality_parts}) WHERE total > 0"
    )
    sql["load_log_entry"] = w(*UPLOAD) + (
        "SELECT (SELECT count(*) FROM upload_new) AS registros_limpios, "
        "(SELECT count(*) FROM upload_duplicates) + (SELECT count(*) FROM upload_existing) AS registros_duplicados, "
        "(SELECT string_agg(concat(campo, ':', registros_faltantes, ':', "
        "printf('%.1f%%', round_even(registros_faltantes / total * 100, 1))), ',' ORDER BY pos) "
        f"FROM ({quality_order}) WHERE total > 0) AS calidad"
    )
    sql["upload_bad_dates"] = w(*UPLOAD) + " UNION ALL ".join(
        f"SELECT '{c}' AS campo, count(*) FILTER (WHERE {c} IS NULL AND upper({o.strip(raw)}) NOT IN "
        f"({', '.join(repr(t) for t in rules.MISSING_TOKENS)})) AS fechas_ilegibles FROM "
        f"(SELECT r.*, {o.parse_ts(raw)} AS {c} FROM raw_upload r WHERE {o.clean('r.\"File\"')} <> '{rules.PLACEHOLDER}')"
        for c, raw in (("fecha_file", '"Fecha File"'), ("fecha_cierre", '"Fecha Cierre"'), ("fecha_primera_factura", '"Fch Primera Fact Prov"'))
    )
    sql["ops_read"] = w(OPS) + (
        "SELECT file, tipo, operativo, CAST(CAST(fecha_file AS DATE) AS TIMESTAMP) AS fecha_file, fecha_cierre, estado FROM ops "
        "WHERE CAST(substr(file, 2, 9) AS BIGINT) % 7 <> 0"
    )
    sql["append_operations"] = w(OPS) + (
        "SELECT count(*) FILTER (WHERE estado IS NULL) AS primera, count(*) FILTER (WHERE estado IS NOT NULL) AS segunda, "
        "count(*) AS filas, count(DISTINCT file) AS claves FROM ops"
    )
    sql["store_split"] = w(*UPLOAD) + (
        f"SELECT {UPCOLS}, file IN (SELECT file FROM existing_keys) AS almacenada FROM upload_dedupe"
    )
    sql["store_loads"] = w(*UPLOAD) + (
        "SELECT file, tipo, operativo FROM upload_new UNION ALL SELECT file, NULL, NULL FROM existing_keys"
    )
    awkward = (
        "SELECT l_orderkey || '-' || l_linenumber AS clave, '  say \"' || l_returnflag || '\", x ' AS cita, "
        "'a,' || l_orderkey || '-' || l_linenumber || chr(10) || 'line two' || chr(13) || chr(10) || 'three ' AS lineas, "
        "CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS nulo FROM lineitem"
    )
    sql["upload_csv_roundtrip"] = awkward
    sql["export_csv_roundtrip"] = awkward
    sql["load_log_read"] = w(o.LOAD_LOG_CTE) + "SELECT fecha_carga, registros_limpios, registros_duplicados FROM load_log"
    sql["sessions_since"] = w(o.SESSIONS_CTE) + (
        f"SELECT username, session_start, session_end, duration_minutes FROM sessions WHERE session_start >= {SINCE}"
    )
    sql["sessions_dead_letter"] = w(o.SESSIONS_CTE) + "SELECT username, duration_minutes, true AS con_error FROM sessions"
    sql["load_log_kpis"] = w(o.LOAD_LOG_CTE) + (
        "SELECT * FROM (SELECT count(*) AS total_cargas, CAST(sum(registros_limpios) AS BIGINT) AS total_limpios, "
        "CAST(sum(registros_duplicados) AS BIGINT) AS total_descartados, "
        "arg_max(registros_limpios, fecha_carga) AS ultimos_limpios, "
        "arg_max(registros_duplicados, fecha_carga) AS ultimos_descartados FROM load_log) WHERE total_cargas > 0"
    )
    sql["latest_load_quality"] = (
        "WITH lm AS (SELECT max(date_trunc('month', o_orderdate)) AS mx FROM orders), "
        "s AS (SELECT o_orderstatus AS campo, count(*) AS n FROM orders "
        "WHERE date_trunc('month', o_orderdate) = (SELECT mx FROM lm) GROUP BY 1) "
        "SELECT campo, n AS registros_faltantes, "
        "printf('%.1f%%', round_even(n / (SELECT sum(n) FROM s) * 100, 1)) AS porcentaje FROM s"
    )

    owners = ", ".join(f"'{x}'" for x in FILTER_OWNERS)
    months = ", ".join(f"'{m}'" for m in FILTER_MONTHS)
    types = ", ".join(f"'{t}'" for t in FILTER_TYPES)
    years = ", ".join(str(y) for y in FILTER_YEARS)
    sql["filter_global"] = w(OPS) + (
        f"SELECT file, tipo, operativo, fecha_file FROM ops WHERE year(fecha_file) IN ({years}) "
        f"AND strftime(fecha_file, '%Y-%m') IN ({months}) AND tipo IN ({types}) AND operativo IN ({owners})"
    )
    sql["filter_facets"] = w(OPS) + (
        "SELECT 'anio' AS facet, CAST(year(fecha_file) AS VARCHAR) AS value FROM ops WHERE fecha_file IS NOT NULL "
        "UNION SELECT 'mes', strftime(fecha_file, '%Y-%m') FROM ops WHERE fecha_file IS NOT NULL "
        "UNION SELECT 'tipo', tipo FROM ops WHERE tipo IS NOT NULL "
        "UNION SELECT 'operativo', operativo FROM ops WHERE operativo IS NOT NULL"
    )
    months_es = ", ".join(f"'{m.capitalize()}'" for m in rules.MONTH_NAMES_ES)
    sql["filter_facets_years"] = w(OPS) + (
        "SELECT 'anio' AS facet, CAST(year(fecha_file) AS VARCHAR) AS value, CAST(year(fecha_file) AS VARCHAR) AS etiqueta FROM ops "
        f"UNION SELECT 'mes', strftime(fecha_file, '%Y-%m'), ([{months_es}])[month(fecha_file)] || ' ' || year(fecha_file) FROM ops "
        f"WHERE year(fecha_file) IN ({years}) "
        "UNION SELECT 'tipo', tipo, tipo FROM ops WHERE tipo IS NOT NULL "
        "UNION SELECT 'operativo', operativo, operativo FROM ops WHERE operativo IS NOT NULL"
    )
    sql["open_ops"] = w(OPS) + f"SELECT file, operativo, tipo, estado FROM ops WHERE {o.OPEN}"
    sql["closed_durations"] = w(OPS, o.CLOSED_CTE) + f"SELECT {CLOSED_COLS} FROM closed"

    sql["monthly_volume"] = w(OPS) + (
        "SELECT strftime(fecha_file, '%Y-%m') AS anio_mes, count(file) AS operaciones FROM ops "
        "WHERE fecha_file IS NOT NULL GROUP BY 1"
    )
    sql["type_distribution"] = w(OPS) + (
        "SELECT tipo, count(*) AS operaciones, round_even(count(*) / sum(count(*)) OVER (), 6) AS proporcion "
        "FROM ops WHERE tipo IS NOT NULL GROUP BY tipo"
    )
    sql["owner_workload_top"] = w(OPS) + (
        "SELECT operativo, count(*) AS operaciones FROM ops WHERE operativo IS NOT NULL "
        "GROUP BY 1 ORDER BY operaciones DESC, operativo LIMIT 15"
    )
    sql["owner_type_summary"] = w(OPS) + (
        "SELECT operativo, tipo, count(file) AS total_operaciones FROM ops "
        "WHERE operativo IS NOT NULL AND tipo IS NOT NULL GROUP BY 1, 2"
    )
    sql["total_operations"] = w(OPS) + "SELECT count(*) AS total_operaciones FROM ops"
    sql["active_months"] = w(OPS) + (
        "SELECT CAST(greatest(count(DISTINCT strftime(fecha_file, '%Y-%m')), 1) AS BIGINT) AS meses FROM ops"
    )
    sql["flow_classification"] = w(*FLOW_SQL_CTES) + (
        "SELECT operativo, tipo, total_general, round_even(promedio_mensual, 6) AS promedio_mensual, "
        "round_even(promedio_ideal, 6) AS promedio_ideal, round_even(indice_flujo, 6) AS indice_flujo, nivel FROM i"
    )
    sql["level_counts"] = w(*FLOW_SQL_CTES) + (
        "SELECT lv.nivel, count(i.nivel) AS cantidad FROM "
        + o.values_table([("ALTO",), ("MEDIO",), ("BAJO",)], ["nivel"])
        + " lv LEFT JOIN i ON i.nivel = lv.nivel GROUP BY lv.nivel"
    )

    sql["available_capacity"] = w(*CAPACITY_SQL_CTES) + "SELECT operativo, tipo, cargas_posibles_adicionales FROM cap"
    sql["open_load"] = w(OPS, OPEN_LOAD_CTE) + "SELECT * FROM l"
    sql["top_open_count"] = w(OPS, OPEN_LOAD_CTE) + (
        "SELECT * FROM l ORDER BY cantidad_operaciones DESC, operativo LIMIT 15"
    )
    sql["top_open_effort"] = w(OPS, OPEN_LOAD_CTE) + "SELECT * FROM l ORDER BY esfuerzo_total DESC, operativo LIMIT 15"
    sql["hidden_overload"] = w(
        OPS,
        OPEN_LOAD_CTE,
        "e AS (SELECT * FROM l ORDER BY esfuerzo_total DESC, operativo LIMIT 5)",
        "c AS (SELECT operativo FROM l ORDER BY cantidad_operaciones DESC, operativo LIMIT 5)",
    ) + "SELECT operativo, esfuerzo_total FROM e WHERE operativo NOT IN (SELECT operativo FROM c)"

    sql["cycle_vs_standard"] = w(*CMP_CTES) + "SELECT * FROM cmp"
    sql["standard_vs_real_long"] = w(*CMP_CTES) + (
        "SELECT tipo, 'tiempo_estandar' AS metrica, CAST(tiempo_estandar AS DOUBLE) AS dias FROM cmp "
        "UNION ALL SELECT tipo, 'duracion_real_promedio', duracion_real_promedio FROM cmp "
        "WHERE duracion_real_promedio IS NOT NULL"
    )
    sql["owner_performance"] = w(OPS, o.CLOSED_CTE) + (
        "SELECT operativo, round_even(avg(duracion_real_dias), 1) AS duracion_promedio, "
        "count(duracion_real_dias) AS cerradas, min(duracion_real_dias) AS mas_rapido, "
        "max(duracion_real_dias) AS mas_lento FROM closed WHERE operativo IS NOT NULL GROUP BY 1"
    )
    sql["owner_efficacy"] = w(OPS, o.CLOSED_CTE) + (
        "SELECT operativo, tipo, round_even(avg(CASE WHEN coalesce(duracion_real_dias <= "
        f"{STD_SQL}, false) THEN 1.0 ELSE 0.0 END)::DOUBLE * 100, 1) AS eficacia_historica "
        "FROM closed WHERE operativo IS NOT NULL AND tipo IS NOT NULL GROUP BY 1, 2"
    )
    sql["owner_speed"] = w(OPS, o.CLOSED_CTE) + (
        "SELECT operativo, tipo, round_even(avg(duracion_real_dias), 6) AS velocidad_promedio_dias "
        "FROM closed WHERE operativo IS NOT NULL AND tipo IS NOT NULL GROUP BY 1, 2"
    )
    sql["slow_operations"] = w(*SLOW_CTES) + f"SELECT {CLOSED_COLS} FROM slow"
    sql["bottleneck_causes"] = w(*SLOW_CTES) + "SELECT dimension, valor, operaciones, posicion FROM ranked WHERE posicion <= 3"
    sql["bottleneck_insight"] = w(*SLOW_CTES) + (
        "SELECT umbral, tipo, operativo, cliente FROM (SELECT round_even((SELECT thr FROM st), 6) AS umbral, "
        "max(CASE WHEN dimension = 'tipo' THEN valor END) AS tipo, "
        "max(CASE WHEN dimension = 'operativo' THEN valor END) AS operativo, "
        "max(CASE WHEN dimension = 'cliente' THEN valor END) AS cliente, count(*) AS n "
        "FROM ranked WHERE posicion = 1) WHERE n > 0"
    )

    sql["allocation_guide"] = w(*GUIDE_SQL_CTES) + GUIDE_SELECT
    sql["allocation_top"] = w(*GUIDE_SQL_CTES) + GUIDE_SELECT + (
        " ORDER BY indice_estrategico DESC, tipo, operativo LIMIT 15"
    )

    names = ", ".join(f'{c} AS "{label}"' for c, label in ALLOCATION_LABELS.items())
    sql["allocation_top_labelled"] = f"SELECT {names} FROM ({sql['allocation_top']})"
    sql["forecast_checks"] = w(OPS, DAILY_CTE) + (
        f"SELECT serie, count(*) + {rules.FORECAST_HORIZON_DAYS} AS filas, min(ds) AS primer_dia, "
        f"CAST(max(ds) + {rules.FORECAST_HORIZON_DAYS} AS DATE) AS ultimo_dia, count(*) + {rules.FORECAST_HORIZON_DAYS} AS en_banda, "
        f"count(*) + {rules.FORECAST_HORIZON_DAYS} AS aditivas, 0 AS mas_estrechas FROM daily GROUP BY serie "
        f"HAVING sum(y) >= {rules.FORECAST_MIN_ROWS} AND count(*) >= {rules.FORECAST_MIN_DAYS}"
    )
    waves = [(forecast.WEEKLY_PERIOD, forecast.WEEKLY_ORDER), (forecast.YEARLY_PERIOD, forecast.YEARLY_ORDER)]
    fourier = ", ".join(
        f"{f}(2 * pi() * (e * {k}) / {period})" for period, order in waves for f in ("sin", "cos") for k in range(1, order + 1)
    )
    sql["forecast_equations"] = w(
        OPS,
        DAILY_CTE,
        "dd AS (SELECT serie, CAST(ds - DATE '1970-01-01' AS BIGINT) AS e, CAST(y AS DOUBLE) AS y, "
        "row_number() OVER (PARTITION BY serie ORDER BY ds) - 1 AS rank FROM daily)",
        "st AS (SELECT serie, count(*) AS n, min(e) AS e0, greatest(max(e) - min(e), 1)::DOUBLE AS span, greatest(max(y), 1) AS scale, "
        f"CAST(floor(count(*) * {forecast.CHANGEPOINT_RANGE}::DOUBLE) AS BIGINT) AS win FROM dd GROUP BY serie "
        f"HAVING sum(y) >= {rules.FORECAST_MIN_ROWS} AND count(*) >= {rules.FORECAST_MIN_DAYS})",
        f"sc AS (SELECT *, greatest(least({forecast.N_CHANGEPOINTS}, win - 1), 0) AS ncp FROM st)",
        "cp AS (SELECT sc.serie, list((dd.e - e0) / span ORDER BY dd.e) AS cps FROM sc JOIN dd USING (serie) "
        "WHERE list_contains(list_transform(range(1, ncp + 1), lambda k: CAST(round_even(k * ((win - 1) / ncp), 0) AS BIGINT)), dd.rank) GROUP BY sc.serie)",
        "x AS (SELECT serie, list_concat([1.0::DOUBLE, t], list_transform(coalesce(cps, []), lambda c: greatest(t - c, 0)), "
        f"[{fourier}], [y / scale]) AS v FROM (SELECT dd.serie, e, y, scale, (e - e0) / span AS t, cps "
        "FROM dd JOIN sc USING (serie) LEFT JOIN cp USING (serie)))",
        "a AS (SELECT serie, unnest(range(len(v))) AS i, v FROM x)",
        "b AS (SELECT serie, i, unnest(range(i, len(v))) AS j, v FROM a)",
    ) + "SELECT serie, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round_even(sum(v[i + 1] * v[j + 1]) + " + f"{OFF_TIES}::DOUBLE, 3) + 0.0::DOUBLE AS valor FROM b GROUP BY serie, i, j"
    sql["daily_series"] = w(OPS, DAILY_CTE) + "SELECT serie, ds, y FROM daily"
    sql["forecast_eligible"] = w(OPS, DAILY_CTE) + (
        "SELECT serie, CAST(sum(y) AS BIGINT) AS filas, count(*) AS dias FROM daily GROUP BY serie "
        f"HAVING sum(y) >= {rules.FORECAST_MIN_ROWS} AND count(*) >= {rules.FORECAST_MIN_DAYS}"
    )

    sql["sessionize"] = w(o.SESSIONS_CTE) + (
        "SELECT username, session_start, session_end, duration_minutes, "
        "array_to_string(pages_visited, ',') AS pages FROM sessions"
    )
    sql["session_summary"] = w(o.SESSIONS_CTE) + (
        "SELECT * FROM (SELECT count(*) AS total_sessions, count(DISTINCT username) AS unique_users, "
        "round_even(avg(duration_minutes), 6) AS avg_duration_minutes, "
        f"round_even(CAST(sum(duration_minutes) AS DOUBLE) / 60.0, 6) AS total_hours FROM sessions "
        f"WHERE session_start >= {SINCE}) WHERE total_sessions > 0"
    )
    for days in USAGE_DAYS:
        since = f"TIMESTAMP '{(AS_OF - dt.timedelta(days=days)).isoformat(sep=' ')}'"
        sql[f"session_summary_{days}"] = sql["session_summary"].replace(SINCE, since)
    sql["session_summary_periods"] = w(o.SESSIONS_CTE) + " UNION ALL ".join(
        f"SELECT {days} AS days, * FROM (SELECT count(*) AS total_sessions, count(DISTINCT username) AS unique_users, "
        "round_even(avg(duration_minutes), 6) AS avg_duration_minutes, "
        "round_even(CAST(sum(duration_minutes) AS DOUBLE) / 60.0, 6) AS total_hours FROM sessions "
        f"WHERE session_start >= TIMESTAMP '{(AS_OF - dt.timedelta(days=days)).isoformat(sep=' ')}') WHERE total_sessions > 0"
        for days in rules.USAGE_PERIODS
    )
    sql["sessions_by_user"] = w(o.SESSIONS_CTE) + (
        f"SELECT username, count(*) AS sesiones FROM sessions WHERE session_start >= {SINCE} "
        "AND username IS NOT NULL GROUP BY 1"
    )
    sql["sessions_by_day"] = w(o.SESSIONS_CTE) + (
        f"SELECT CAST(session_start AS DATE) AS fecha, count(*) AS sesiones FROM sessions "
        f"WHERE session_start >= {SINCE} GROUP BY 1"
    )
    sql["recent_sessions"] = w(o.SESSIONS_CTE) + (
        "SELECT username, strftime(session_start, '%Y-%m-%d %H:%M') AS session_start, "
        "strftime(session_end, '%Y-%m-%d %H:%M') AS session_end, duration_minutes FROM sessions "
        "ORDER BY sessions.session_start DESC, username LIMIT 50"
    )
    # a session is emitted once the final watermark (last event - lateness)
    # reaches its window end (last event of the session + gap)
    sql["sessionize_stream"] = w(o.SESSIONS_CTE) + (
        "SELECT username, session_start, session_end, duration_minutes, array_to_string(pages_visited, ',') AS pages "
        f"FROM sessions WHERE session_end + INTERVAL {STREAM_GAP.split()[0]} HOUR "
        f"<= (SELECT max(ts) FROM events) - INTERVAL {STREAM_WATERMARK.split()[0]} HOUR"
    )
    # in two levels a session comes out once the watermark reaches the end of
    # the cell of one gap that holds the end of its gap
    gap_us = int(STREAM_GAP.split()[0]) * 3_600_000_000
    sql["sessionize_stream_cells"] = w(o.SESSIONS_CTE) + (
        "SELECT username, session_start, session_end, duration_minutes, array_to_string(pages_visited, ',') AS pages "
        f"FROM sessions WHERE ((epoch_us(session_end) + {gap_us}) // {gap_us} + 1) * {gap_us} "
        f"<= epoch_us((SELECT max(ts) FROM events) - INTERVAL {STREAM_WATERMARK.split()[0]} HOUR)"
    )
    sql["stream_event_split"] = (
        "SELECT 'user' || CAST(user_id AS VARCHAR) AS username, ts, event_type, "
        f"CASE WHEN minute(ts) % 5 = 0 AND ts < (SELECT max(ts) FROM events WHERE minute(ts) % 5 <> 0) - INTERVAL 1 HOUR THEN '{LATE}' END AS motivo "
        "FROM events WHERE ts IS NOT NULL"
    )
    return sql


def catalog() -> dict[str, Query]:
    spark_q = _spark_queries()
    sql = _oracle()
    return {name: Query(build, sql.get(name)) for name, build in spark_q.items()}
