"""Cycle times against standards, owner performance and bottleneck diagnosis.

Inputs are closed operations from ``filters.closed_durations`` (one row per
operation with ``duracion_real_dias``). Quantile and counts over the whole set
are scalar subqueries; the exact percentile keeps one counter per distinct
duration (whole days), so its state does not grow with the row count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics import rules
from opsmetrics.functions import round_half_even, within_standard

DURATION = "duracion_real_dias"


def reference_times(spark, standard: Mapping[str, int] | None = None, target: Mapping[str, int] | None = None) -> DataFrame:
    """The per-type standard and target table as a DataFrame (one row per rule type)."""
    standard = standard or rules.STANDARD_DAYS
    target = target or rules.TARGET_DAYS
    rows = [(t, int(standard[t]), int(target[t]) if t in target else None) for t in standard]
    literals = [
        F.struct(
            F.lit(t).alias("tipo"), F.lit(std).cast("bigint").alias("tiempo_estandar"), F.lit(goal).cast("bigint").alias("meta_mejora")
        )
        for t, std, goal in rows
    ]
    return spark.range(1).select(F.inline(F.array(*literals)))


def cycle_time_vs_standard(
    closed: DataFrame,
    standard: Mapping[str, int] | None = None,
    target: Mapping[str, int] | None = None,
    type_col: str = "tipo",
) -> DataFrame:
    """Every rule type with its standard, target and observed mean duration
    (rounded to 1 decimal, half-even; NULL when the type has no closed rows)."""
    observed = closed.groupBy(F.col(type_col).alias("tipo")).agg(F.avg(DURATION).alias("_mean"))
    ref = reference_times(closed.sparkSession, standard, target)
    return ref.join(observed, on="tipo", how="left").select(
        "tipo", "tiempo_estandar", "meta_mejora", round_half_even("_mean", 1).alias("duracion_real_promedio")
    )


def standard_vs_real_long(comparison: DataFrame) -> DataFrame:
    """Long form of the comparison: (tipo, metrica, dias), NULL days dropped."""
    wide = comparison.select(
        "tipo",
        F.col("tiempo_estandar").cast("double").alias("tiempo_estandar"),
        F.col("duracion_real_promedio").cast("double").alias("duracion_real_promedio"),
    )
    return wide.unpivot("tipo", ["tiempo_estandar", "duracion_real_promedio"], "metrica", "dias").where(
        F.col("dias").isNotNull()
    )


def owner_performance(closed: DataFrame, owner_col: str = "operativo", sort: bool = True) -> DataFrame:
    """Per owner: mean duration (1 decimal), closed count, fastest and slowest."""
    out = (
        closed.where(F.col(owner_col).isNotNull())
        .groupBy(owner_col)
        .agg(
            round_half_even(F.avg(DURATION), 1).alias("duracion_promedio"),
            F.count(DURATION).alias("cerradas"),
            F.min(DURATION).alias("mas_rapido"),
            F.max(DURATION).alias("mas_lento"),
        )
    )
    return out.orderBy("duracion_promedio", owner_col) if sort else out


def success_flag(standard: Mapping[str, int] | None = None, type_col: str = "tipo"):
    """Closed within the type's standard; an unknown type is never a success."""
    return within_standard(DURATION, type_col, standard)


def owner_efficacy(
    closed: DataFrame, standard: Mapping[str, int] | None = None, owner_col: str = "operativo", type_col: str = "tipo"
) -> DataFrame:
    """Percent of closed operations within standard per (owner, type), 1 decimal."""
    rate = F.avg(success_flag(standard, type_col).cast("double")) * F.lit(100.0)
    return (
        closed.dropna(subset=[owner_col, type_col])
        .groupBy(owner_col, type_col)
        .agg(round_half_even(rate, 1).alias("eficacia_historica"))
    )


def owner_speed(closed: DataFrame, owner_col: str = "operativo", type_col: str = "tipo") -> DataFrame:
    """Mean closed duration per (owner, type), unrounded."""
    return (
        closed.dropna(subset=[owner_col, type_col])
        .groupBy(owner_col, type_col)
        .agg(F.avg(DURATION).alias("velocidad_promedio_dias"))
    )


def slow_stats(closed: DataFrame, q: float = rules.SLOW_QUANTILE):
    """Scalar subquery: struct(threshold = linear quantile q of durations, n = rows)."""
    return closed.select(
        F.struct(F.percentile(DURATION, q).alias("umbral"), F.count(F.lit(1)).alias("n"))
    ).scalar()


def slow_operations(closed: DataFrame, q: float = rules.SLOW_QUANTILE, min_rows: int = rules.BOTTLENECK_MIN_ROWS) -> DataFrame:
    """Closed operations strictly slower than the q-quantile; empty below min_rows."""
    stats = slow_stats(closed, q)
    return closed.where((F.col(DURATION) > stats["umbral"]) & (stats["n"] >= F.lit(min_rows)))


def bottleneck_causes(slow: DataFrame, k: int = 3, dims: list[str] | None = None) -> DataFrame:
    """Top-k values of each dimension among slow operations, by count then value.

    Dimensions are unpivoted in one pass and counted in one aggregation; the
    ``row_number() <= k`` filter is planned as a window group limit, so each
    partition forwards at most k rows per dimension.
    """
    present = [d for d in (dims or ["tipo", "operativo", "cliente"]) if d in slow.columns]
    stacked = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in present)
    counts = (
        slow.select(F.expr(f"stack({len(present)}, {stacked}) AS (dimension, valor)"))
        .where(F.col("valor").isNotNull())
        .groupBy("dimension", "valor")
        .agg(F.count(F.lit(1)).alias("operaciones"))
    )
    w = Window.partitionBy("dimension").orderBy(F.desc("operaciones"), F.asc("valor"))
    return counts.withColumn("posicion", F.row_number().over(w).cast("bigint")).where(F.col("posicion") <= k)


def bottleneck_insight(
    closed: DataFrame, q: float = rules.SLOW_QUANTILE, min_rows: int = rules.BOTTLENECK_MIN_ROWS
) -> DataFrame:
    """One row: the slow threshold and the leading type, owner and client among
    slow operations. No row when the diagnosis does not apply."""
    leaders = bottleneck_causes(slow_operations(closed, q, min_rows), k=1)
    stats = slow_stats(closed, q)
    pick = {d: F.max(F.when(F.col("dimension") == d, F.col("valor"))).alias(d) for d in ["tipo", "operativo", "cliente"]}
    return (
        leaders.agg(F.count(F.lit(1)).alias("_n"), *pick.values())
        .where(F.col("_n") > 0)
        .select(stats["umbral"].alias("umbral"), "tipo", "operativo", "cliente")
    )
