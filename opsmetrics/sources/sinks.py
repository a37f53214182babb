"""Sinks. Writes run on the executors; no rows pass through the driver."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics import rules, schema
from opsmetrics.functions import quality_label, round_half_even, ts_literal


def _writer(df: DataFrame, fmt: str, mode: str, options: dict | None):
    return df.write.format(fmt).mode(mode).options(**(options or {}))


def to_contract(df: DataFrame) -> DataFrame:
    """Project onto the stored operations columns; missing ones become typed NULLs."""
    cols = []
    for field in schema.OPERATIONS.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def append_operations(
    new_df: DataFrame, path: str | None, fmt: str = "parquet", options: dict | None = None
) -> int:
    """Append new operations and return how many rows were written.

    The count is an observed metric of the write job itself (no second pass).
    An empty frame writes no data files. Rerunning an upload is safe because
    the new-versus-existing split runs against this same target first.
    """
    observation = Observation("append_operations")
    out = to_contract(new_df).observe(observation, F.count(F.lit(1)).alias("rows"))
    writer = _writer(out, fmt, "append", options)
    writer.save(path) if path is not None else writer.save()
    return int(observation.get.get("rows", 0))


def load_log_row(summary: DataFrame, loaded_at: dt.datetime | None = None, fields: list[str] | None = None) -> DataFrame:
    """One load-log row from the figures of ``ingest.upload_summary``.

    ``registros_duplicados`` counts every copy of a duplicated key (including
    the kept one) plus the keys that already existed, as the log always did.
    The quality records are in the order of the fields; none if nothing is new.
    """
    labels = F.array(*[F.lit(quality_label(f)) for f in fields or rules.QUALITY_FIELDS])

    def record(missing, i):
        share = F.try_divide(missing, F.col("nuevos")) * F.lit(100.0)
        return F.struct(
            F.get(labels, i).alias("campo"),
            missing.cast("bigint").alias("registros_faltantes"),
            F.format_string("%.1f%%", round_half_even(share, 1)).alias("porcentaje"),
        )

    records = F.when(F.col("nuevos") > 0, F.transform("faltantes", record)).otherwise(F.array())
    stamp = ts_literal(loaded_at) if loaded_at is not None else F.localtimestamp()
    return summary.select(
        F.col("nuevos").cast("bigint").alias("registros_limpios"),
        (F.col("duplicados") + F.col("existentes")).cast("bigint").alias("registros_duplicados"),
        records.cast(T.ArrayType(schema.QUALITY_RECORD)).alias("calidad_json"),
        stamp.cast("timestamp_ntz").alias("fecha_carga"),
    )


def append_load_log(
    summary: DataFrame,
    path: str | None,
    fmt: str = "parquet",
    options: dict | None = None,
    loaded_at: dt.datetime | None = None,
) -> None:
    """Append the one-row load log entry for an upload."""
    row = load_log_row(summary, loaded_at)
    writer = _writer(row, fmt, "append", options)
    writer.save(path) if path is not None else writer.save()


def append_sessions(
    sessions: DataFrame,
    path: str | None,
    dead_letter_path: str,
    fmt: str = "parquet",
    options: dict | None = None,
) -> bool:
    """Append sessions; if the write fails, append the same rows with an ``error``
    text to a JSON dead-letter folder instead. Returns True when the main write
    succeeded. Also usable as a ``foreachBatch`` body."""
    try:
        writer = _writer(sessions, fmt, "append", options)
        writer.save(path) if path is not None else writer.save()
        return True
    except Exception as exc:  # the failure itself is the data of the fallback sink
        write_dead_letter(sessions, exc, dead_letter_path, "append")
        return False


def write_dead_letter(rows: DataFrame, exc: Exception, path: str, mode: str = "append") -> None:
    """Write rows that could not be stored, with the error text, as JSON."""
    message = f"{type(exc).__name__}: {exc}"
    rows.withColumn("error", F.lit(message)).write.mode(mode).json(path)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write a report as CSV with a header. Nested columns are written as JSON text.

    Quotes are doubled and blanks kept, so spreadsheets and ``read_upload`` read
    back the values as they were.

    ``single_file`` coalesces to one partition; use it only for small reports.
    """
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(field.name)).alias(field.name))
        else:
            cols.append(F.col(field.name))
    out = df.select(*cols)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(
        header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)
