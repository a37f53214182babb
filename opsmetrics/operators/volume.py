"""Volume trends, distributions, summaries and flow classification.

All are grouped aggregations (partial aggregation before the shuffle). Scalars
over the whole frame (active months) are scalar subqueries, not cross joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics import rules
from opsmetrics.functions import level_of, month_key, rule_lookup


def monthly_volume(df: DataFrame, date_col: str = "fecha_file", key: str = "file") -> DataFrame:
    """Operations per calendar month (non-null keys counted)."""
    return (
        df.where(F.col(date_col).isNotNull())
        .groupBy(month_key(date_col).alias("anio_mes"))
        .agg(F.count(key).alias("operaciones"))
    )


def type_distribution(df: DataFrame, type_col: str = "tipo") -> DataFrame:
    """Rows per type and share of all typed rows (NULL types are not counted).

    The share divides by a scalar subquery over the same aggregate, so the only
    shuffle is the (tiny) per-type aggregation.
    """
    counts = df.where(F.col(type_col).isNotNull()).groupBy(type_col).agg(F.count(F.lit(1)).alias("operaciones"))
    total = counts.select(F.sum("operaciones")).scalar()
    return counts.select(type_col, "operaciones", (F.col("operaciones") / total).alias("proporcion"))


def owner_workload(df: DataFrame, n: int = rules.TOP_OWNERS, owner_col: str = "operativo") -> DataFrame:
    """Top-n owners by rows; ties broken by owner name (map-side top-k)."""
    return (
        df.where(F.col(owner_col).isNotNull())
        .groupBy(owner_col)
        .agg(F.count(F.lit(1)).alias("operaciones"))
        .orderBy(F.desc("operaciones"), F.asc(owner_col))
        .limit(n)
    )


def owner_type_summary(
    df: DataFrame, owner_col: str = "operativo", type_col: str = "tipo", key: str = "file", sort: bool = True
) -> DataFrame:
    """Operations per (owner, type); owner ascending, count descending."""
    out = df.dropna(subset=[owner_col, type_col]).groupBy(owner_col, type_col).agg(F.count(key).alias("total_operaciones"))
    return out.orderBy(F.asc(owner_col), F.desc("total_operaciones"), F.asc(type_col)) if sort else out


def total_operations(df: DataFrame) -> DataFrame:
    """Number of rows, one row."""
    return df.agg(F.count(F.lit(1)).alias("total_operaciones"))


def _month_number(date_col: str) -> Column:
    return F.year(date_col) * 100 + F.month(date_col)


def active_months_value(df: DataFrame, date_col: str = "fecha_file") -> Column:
    """Distinct months present in the whole frame, at least 1 (scalar subquery)."""
    return df.select(F.greatest(F.count_distinct(_month_number(date_col)), F.lit(1)).cast("bigint")).scalar()


def active_months(df: DataFrame, date_col: str = "fecha_file") -> DataFrame:
    """Distinct months present, at least 1, one row."""
    return df.agg(F.greatest(F.count_distinct(_month_number(date_col)), F.lit(1)).cast("bigint").alias("meses"))


def flow_classification(
    df: DataFrame,
    months: int | Column | None = None,
    ideal: Mapping[str, float] | None = None,
    owner_col: str = "operativo",
    type_col: str = "tipo",
    key: str = "file",
) -> DataFrame:
    """Monthly flow per (owner, type) against the ideal monthly rate.

    ``months`` defaults to the active months of the whole frame (not per group).
    Unknown types get an ideal of 0 and an index of 0.
    """
    n_months = active_months_value(df) if months is None else (months if isinstance(months, Column) else F.lit(months))
    ideal_rate = rule_lookup(type_col, ideal or rules.IDEAL_PER_MONTH, rules.DEFAULT_IDEAL).cast("double")
    grouped = df.dropna(subset=[owner_col, type_col]).groupBy(owner_col, type_col).agg(F.count(key).alias("total_general"))
    monthly = F.col("total_general") / n_months.cast("double")
    index = F.coalesce(F.col("promedio_mensual") / F.nullif(F.col("promedio_ideal"), F.lit(0.0)) * F.lit(100.0), F.lit(0.0))
    return (
        grouped.withColumns({"promedio_mensual": monthly, "promedio_ideal": ideal_rate})
        .withColumn("indice_flujo", index)
        .withColumn("nivel", level_of("indice_flujo"))
        .select(owner_col, type_col, "total_general", "promedio_mensual", "promedio_ideal", "indice_flujo", "nivel")
    )


def level_counts(classified: DataFrame) -> DataFrame:
    """Rows per level, always the three levels (zeros kept)."""
    levels = [rules.LEVEL_HIGH, rules.LEVEL_MID, rules.LEVEL_LOW]
    aggs = [F.count_if(F.col("nivel") == F.lit(lv)).alias(f"_n{i}") for i, lv in enumerate(levels)]
    stacked = ", ".join(f"'{lv}', _n{i}" for i, lv in enumerate(levels))
    return classified.agg(*aggs).select(F.expr(f"stack(3, {stacked}) AS (nivel, cantidad)")).select(
        "nivel", F.col("cantidad").cast("bigint").alias("cantidad")
    )
