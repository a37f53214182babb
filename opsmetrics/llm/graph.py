"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared


def components(links: DataFrame, shared: Shared) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for every node of ``links(a, b)``.

    Each round takes the smallest label of the neighbours, then the label of the
    label, so long chains halve. A node with very many links is one group of a
    partial aggregate. Every round is written, so no lineage grows.
    """
    both = shared.table(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = shared.table(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("label")
        )
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        previous = labels
        lower = shared.table(
            previous.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        target = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = shared.table(
            lower.join(target, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("next", "label")).alias("label")
            )
        )
        shared.drop(previous, lower)
        if labels.where("label <> old").isEmpty():
            shared.drop(both)
            return labels
