"""Allocation guide: spare capacity x speed x historical success per (owner, type)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics import rules
from opsmetrics.functions import round_half_even
from opsmetrics.operators.workload import capacity_grid, owner_type_stats, pin_stats, spare_capacity

IMPUTED_DIGITS = 9
OUTPUT = ["cargas_posibles_adicionales", "velocidad_promedio_dias", "eficacia_historica", "indice_estrategico"]


def type_speeds(stats: DataFrame, owner_col: str = "operativo", type_col: str = "tipo") -> DataFrame:
    """Per type of the grid, from the stats of the pairs that occur alone: the owners
    with the type (``_present``) and all owners (``_owners``), and the speeds that
    fill the gaps: the type's mean (``_vel_tipo``) and the overall mean (``_vel_todo``).

    All pairs of a type without a speed of their own take its mean. So the overall
    mean over the grid after that step follows from the type's sum and the number
    of owners, and the grid itself is not needed for it. Means of doubles depend
    on summation order (partitioning); the imputed means are fixed to 1e-9 days
    so that the rounded index cannot flip between runs.
    """
    pinned = pin_stats(stats, owner_col, type_col)
    owners = pinned.select(F.count_distinct(owner_col)).scalar()
    own = F.when(F.col(owner_col).isNotNull(), F.col("_vel"))
    per_type = (
        pinned.where(F.col(type_col).isNotNull())
        .groupBy(type_col)
        .agg(
            F.count(owner_col).alias("_present"),
            F.count(own).alias("_n"),
            F.sum(own).alias("_sum"),
            round_half_even(F.avg(own), IMPUTED_DIGITS).alias("_vel_tipo"),
        )
        .withColumn("_owners", owners)
    )
    filled = F.when(F.col("_n") > 0, F.col("_sum") + (F.col("_owners") - F.col("_n")) * F.col("_vel_tipo"))
    cells = F.when(F.col("_n") > 0, F.col("_owners"))
    overall = per_type.select(round_half_even(F.try_divide(F.sum(filled), F.sum(cells)), IMPUTED_DIGITS)).scalar()
    return per_type.select(type_col, "_present", "_owners", "_vel_tipo", overall.alias("_vel_todo"))


def _indexed(pairs: DataFrame, speed: Column, efficacy: Column, owner_col: str, type_col: str) -> DataFrame:
    """The guide's columns of pairs with spare capacity."""
    index = (
        (F.col("cargas_posibles_adicionales") / (F.col("velocidad_promedio_dias") + F.lit(1.0)))
        * F.lit(100.0)
        * (F.lit(1.0) + F.col("eficacia_historica") / F.lit(100.0))
    )
    return (
        pairs.where(F.col("cargas_posibles_adicionales") > 0)
        .select(type_col, owner_col, "cargas_posibles_adicionales", speed.alias("velocidad_promedio_dias"), efficacy.alias("eficacia_historica"))
        .withColumn("indice_estrategico", round_half_even(index, 2))
    )


def _speed(own: Column) -> Column:
    return F.coalesce(own, F.col("_vel_tipo"), F.col("_vel_todo"), F.lit(rules.DEFAULT_SPEED_DAYS))


def _efficacy(ok: Column) -> Column:
    return F.coalesce(round_half_even(ok * F.lit(100.0), 1), F.lit(rules.DEFAULT_EFFICACY))


def allocation_guide(
    df: DataFrame,
    ideal: Mapping[str, float] | None = None,
    standard: Mapping[str, int] | None = None,
    owner_col: str = "operativo",
    type_col: str = "tipo",
    sort: bool = True,
) -> DataFrame:
    """Strategic index per (owner, type) with spare capacity.

    One aggregation of the operations at (owner, type) grain gives open counts,
    closed-duration means and success shares; the owner x type grid is made once
    from that frame. Missing efficacy is 50. Missing speed is the type's mean over
    the guide rows, then the overall mean of that imputed column, then 90 days (no
    closed rows at all); both means cover all grid rows, also those without spare
    capacity, and come from ``type_speeds``, a row per type.
    """
    stats = owner_type_stats(df, standard, owner_col, type_col)
    grid = capacity_grid(stats, ideal, owner_col, type_col).join(type_speeds(stats, owner_col, type_col), type_col, "left")
    out = _indexed(grid, _speed(F.col("_vel")), _efficacy(F.col("_ok")), owner_col, type_col)
    return out.orderBy(F.asc(type_col), F.desc("indice_estrategico"), F.asc(owner_col)) if sort else out


def top_allocations(
    df: DataFrame,
    n: int = rules.TOP_OWNERS,
    ideal: Mapping[str, float] | None = None,
    standard: Mapping[str, int] | None = None,
    owner_col: str = "operativo",
    type_col: str = "tipo",
) -> DataFrame:
    """``allocation_top`` of the whole guide, without making the grid.

    Pairs that occur have their own index. All other pairs of a type share one:
    nothing is open, the speed is imputed and the efficacy is the default. So of
    those only the n leading types can be among the first n pairs, and only they
    are matched with the owners.
    """
    stats = owner_type_stats(df, standard, owner_col, type_col)
    types = type_speeds(stats, owner_col, type_col)
    pairs = pin_stats(stats, owner_col, type_col).where(F.col(owner_col).isNotNull() & F.col(type_col).isNotNull())
    occurring = pairs.join(types, type_col).withColumn("cargas_posibles_adicionales", spare_capacity(ideal, type_col))
    first = allocation_top(
        _indexed(occurring, _speed(F.col("_vel")), _efficacy(F.col("_ok")), owner_col, type_col), n, owner_col, type_col
    )

    empty = types.where(F.col("_present") < F.col("_owners")).withColumn(
        "cargas_posibles_adicionales", spare_capacity(ideal, type_col, None)
    )
    shared = _indexed(
        empty.withColumn(owner_col, F.lit(None).cast("string")), _speed(F.lit(None).cast("double")), _efficacy(F.lit(None).cast("double")), owner_col, type_col
    )
    leading = allocation_top(shared, n, owner_col, type_col).agg(F.collect_list(F.struct(type_col, *OUTPUT)))  # at most n
    owners = pin_stats(stats, owner_col, type_col).where(F.col(owner_col).isNotNull()).select(owner_col).distinct()
    others = (
        owners.withColumn("_types", leading.scalar())
        .select(owner_col, F.inline("_types"))
        .join(pairs.select(owner_col, type_col), [owner_col, type_col], "left_anti")
        .select(type_col, owner_col, *OUTPUT)
    )
    return allocation_top(first.unionByName(allocation_top(others, n, owner_col, type_col)), n, owner_col, type_col)


def allocation_top(guide: DataFrame, n: int = rules.TOP_OWNERS, owner_col: str = "operativo", type_col: str = "tipo") -> DataFrame:
    """Top-n guide rows by index; ties by type then owner."""
    return guide.orderBy(F.desc("indice_estrategico"), F.asc(type_col), F.asc(owner_col)).limit(n)
