"""Positions of rows within the groups of a key, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared

#: The lower bits of ``monotonically_increasing_id`` count the rows of a partition.
_IN_PARTITION = (1 << 33) - 1


def number_within(df: DataFrame, keys: list[str], order: list[Column], shared: Shared) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the rows in the order of keys and ``order``, cut into partitions by ranges.

    ``rows`` are those of ``df`` with their range (``part``) and place in it
    (``pos``); nulls come first among keys. ``spans`` has a row for each range
    and key in it: its first place (``start``), its number of rows (``many``), the
    rows of the key in earlier ranges (``before``) and in all (``total``). A key
    with most rows reaches over many ranges, and so do rows that are equal
    throughout, as their place in the input comes last in the order.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + order + [F.col("_seq")]
    ranged = df.withColumn("_seq", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = shared.table(
        ranged.select(
            *(F.col(f"`{c}`") for c in df.columns),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("pos"),
        )
    )
    counts = rows.groupBy("part", *keys).agg(F.min("pos").alias("start"), F.count("*").alias("many"))
    key = Window.partitionBy(*keys)  # over ranges, not rows
    spans = counts.select(
        "*",
        (F.sum("many").over(key.orderBy("part")) - F.col("many")).alias("before"),
        F.sum("many").over(key).alias("total"),
    )
    return rows, shared.table(spans)


def place_in_key() -> Column:
    """The place of a row among those of its key, from 0, once ``rows`` and ``spans`` are joined."""
    return F.col("before") + F.col("pos") - F.col("start")
