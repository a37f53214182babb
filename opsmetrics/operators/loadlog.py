"""Load-log indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_log_kpis(log: DataFrame) -> DataFrame:
    """Loads, summed clean and discarded rows, and the latest load's two figures.

    No row for an empty log. Loads with the same timestamp are ordered by
    clean, then discarded rows, so "latest" is deterministic.
    """
    latest = F.struct("fecha_carga", "registros_limpios", "registros_duplicados")
    return log.agg(
        F.count(F.lit(1)).alias("total_cargas"),
        F.sum("registros_limpios").cast("bigint").alias("total_limpios"),
        F.sum("registros_duplicados").cast("bigint").alias("total_descartados"),
        F.max_by("registros_limpios", latest).cast("bigint").alias("ultimos_limpios"),
        F.max_by("registros_duplicados", latest).cast("bigint").alias("ultimos_descartados"),
    ).where(F.col("total_cargas") > 0)


def latest_load_quality(log: DataFrame) -> DataFrame:
    """The quality records of the newest load, one row per field (same
    tie-break as ``load_log_kpis``)."""
    return (
        log.orderBy(F.desc("fecha_carga"), F.desc("registros_limpios"), F.desc("registros_duplicados"))
        .limit(1)
        .select(F.inline(F.coalesce(F.col("calidad_json"), F.array().cast(log.schema["calidad_json"].dataType))))
    )
