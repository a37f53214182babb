"""Open workload, weighted effort, hidden overload and spare capacity."""

from __future__ import annotations

from collections.abc import Mapping
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics import rules
from opsmetrics.functions import floor_days, is_open, rule_lookup, within_standard
from opsmetrics.sources.readers import coerce_dates


def grid_buckets(spark: SparkSession) -> int:
    """How many owner salts, and as many type buckets, the grid is joined on: the
    pairs of both are at least as many as the shuffle partitions, so that the whole
    cluster makes the grid."""
    return isqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64) - 1) + 1


def owner_type_stats(
    df: DataFrame,
    standard: Mapping[str, int] | None = None,
    owner_col: str = "operativo",
    type_col: str = "tipo",
    state_col: str = "estado",
    key: str = "file",
    start_col: str = "fecha_file",
    end_col: str = "fecha_cierre",
) -> DataFrame:
    """One pass over the operations at (owner, type) grain.

    NULL owners or types stay as their own groups (callers decide whether they
    count). Per group: open operations (non-null keys), closed
    operations with a non-negative duration, their mean duration and their share
    within the type's standard. Partial aggregation runs before the shuffle, so a
    hot (owner, type) pair is reduced map-side; everything downstream works on
    this small frame and Spark reuses its exchange.
    """
    has_dates = start_col in df.columns and end_col in df.columns
    if has_dates:
        df = coerce_dates(df, [start_col, end_col])
        dur = floor_days(start_col, end_col)
        closed = F.col(start_col).isNotNull() & F.col(end_col).isNotNull() & (dur >= 0)
    else:
        dur, closed = F.lit(None).cast("bigint"), F.lit(False)
    ok = within_standard(dur, type_col, standard).cast("double")
    open_ = is_open(state_col) if state_col in df.columns else F.lit(False)
    return df.groupBy(owner_col, type_col).agg(
        F.count(F.when(open_, F.col(key))).alias("_open"),
        F.avg(F.when(closed, dur)).alias("_vel"),
        F.avg(F.when(closed, ok)).alias("_ok"),
    )


STAT_FIELDS = ["_open", "_vel", "_ok"]


def pin_stats(stats: DataFrame, owner_col: str = "operativo", type_col: str = "tipo") -> DataFrame:
    """The same stats, read whole by every branch of a plan.

    The condition is always true, but it keeps all columns of the stats in each
    branch, above the aggregate: their plans stay equal, so the exchange of the
    one fact scan is reused.
    """
    whole = (F.col("_open") >= 0) & (F.coalesce("_vel", F.lit(0.0)) >= 0) & (F.coalesce("_ok", F.lit(0.0)) >= 0)
    return stats.select(
        F.when(whole, F.col(owner_col)).alias(owner_col), F.when(whole, F.col(type_col)).alias(type_col), *STAT_FIELDS
    )


def spare_capacity(ideal: Mapping[str, float] | None = None, type_col: str = "tipo", open_: str | None = "_open") -> Column:
    """Extra operations of a pair: max(ideal - open, 0); without ``open_`` nothing is open."""
    rate = rule_lookup(type_col, ideal or rules.IDEAL_PER_MONTH, rules.DEFAULT_IDEAL)
    taken = F.lit(0) if open_ is None else F.coalesce(F.col(open_), F.lit(0))
    return F.greatest(rate - taken, F.lit(0)).cast("bigint")


def capacity_grid(
    stats: DataFrame,
    ideal: Mapping[str, float] | None = None,
    owner_col: str = "operativo",
    type_col: str = "tipo",
) -> DataFrame:
    """Every owner times every type, with the stats of the pair from
    ``owner_type_stats`` (NULL when the pair never occurs) and the spare capacity.

    Owners and types are the distinct values of the stats. Types are hashed into
    buckets and owners into salts; each owner is repeated for every bucket and
    each type for every salt, so the pairs come from an equi-join, with no list
    of types in any row. The stats of the pair are then joined on (owner, type).
    """
    pinned = pin_stats(stats, owner_col, type_col)
    n = F.lit(grid_buckets(stats.sparkSession))
    every = F.explode(F.sequence(F.lit(0), n - 1))
    owners = pinned.select(owner_col).where(F.col(owner_col).isNotNull()).distinct()
    owners = owners.select(owner_col, F.pmod(F.xxhash64(owner_col), n).cast("int").alias("_s"), every.alias("_b"))
    types = pinned.select(type_col).where(F.col(type_col).isNotNull()).distinct()
    types = types.select(type_col, F.pmod(F.xxhash64(type_col), n).cast("int").alias("_b"), every.alias("_s"))
    grid = owners.join(types, ["_s", "_b"]).select(owner_col, type_col)
    spare = spare_capacity(ideal, type_col)
    return grid.join(pinned, [owner_col, type_col], "left").withColumn("cargas_posibles_adicionales", spare)


def available_capacity(
    df: DataFrame,
    ideal: Mapping[str, float] | None = None,
    owner_col: str = "operativo",
    type_col: str = "tipo",
    state_col: str = "estado",
    key: str = "file",
) -> DataFrame:
    """Extra operations each owner can take per type: max(ideal - open, 0), over
    the grid of every owner and every type of the frame. Empty when there is no
    state column."""
    if state_col not in df.columns:
        return df.sparkSession.createDataFrame([], f"{owner_col} string, {type_col} string, cargas_posibles_adicionales bigint")
    stats = owner_type_stats(df, owner_col=owner_col, type_col=type_col, state_col=state_col, key=key)
    return capacity_grid(stats, ideal, owner_col, type_col).select(
        owner_col, type_col, "cargas_posibles_adicionales"
    )


def open_load_by_owner(
    df: DataFrame,
    effort: Mapping[str, int] | None = None,
    owner_col: str = "operativo",
    type_col: str = "tipo",
    state_col: str = "estado",
    key: str = "file",
) -> DataFrame:
    """Open operations and summed effort points per owner (unknown type = 1 point)."""
    points = rule_lookup(type_col, effort or rules.EFFORT_POINTS, rules.DEFAULT_EFFORT)
    return (
        df.where(is_open(state_col) & F.col(owner_col).isNotNull())
        .groupBy(owner_col)
        .agg(F.count(key).alias("cantidad_operaciones"), F.sum(points).cast("bigint").alias("esfuerzo_total"))
    )


def top_open(load: DataFrame, by: str = "cantidad_operaciones", n: int = rules.TOP_OWNERS, owner_col: str = "operativo") -> DataFrame:
    """Top-n owners of ``open_load_by_owner`` by one measure; ties by owner name."""
    return load.orderBy(F.desc(by), F.asc(owner_col)).limit(n)


def hidden_overload(load: DataFrame, n: int = 5, owner_col: str = "operativo") -> DataFrame:
    """Owners in the top-n by effort who are not in the top-n by count."""
    by_effort = top_open(load, "esfuerzo_total", n, owner_col)
    by_count = top_open(load, "cantidad_operaciones", n, owner_col)
    # owners are unique in ``load``, so matching on (owner, count, effort)
    # equals matching on the owner; keeping both measures makes the two top-n
    # lists read the same aggregate, whose exchange Spark then reuses
    keys = [owner_col, "cantidad_operaciones", "esfuerzo_total"]
    return by_effort.join(by_count.select(*keys), on=keys, how="left_anti").select(owner_col, "esfuerzo_total")
