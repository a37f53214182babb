"""Exact duplicates by distributed most-significant-byte-first radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared, record_id, record_text, tagged

#: Characters that do not count.
BLANKS = r"[\x20\x09-\x0D]+"


def exact_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_width: int = 256,
    growth: int = 4,
    max_width: int = 1 << 20,
) -> DataFrame:
    """A row per document with the document that stays for its text.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``.
    The normalised bytes are split most significant first: each round groups
    the documents still together by their next bytes. A group of one leaves, a
    group whose texts end here is a class of equal texts, the others go on with
    the following, wider bytes. Only bytes decide; there is no digest.

    A round counts its groups with a partial aggregate, writes them as a table
    and joins the documents to it, so a group with a third of the rows is one row
    there and its documents are split over tasks by the adaptive skew join.

    Very long texts that agree take more rounds, each over only those still together;
    no row ever holds more than one text.
    Null texts are empty texts, and empty texts are equal to each other. Of equal
    texts the one with the most code points stays, then the smallest id; a null
    id comes last, and of rows that repeat an id one row stays. An empty table
    gives no rows. Other columns are not read.
    """
    shared = Shared(docs.sparkSession, "exact")
    base = shared.table(tagged(docs.select(id_col, text_col)))
    classes = _classes(base, shared, id_col, text_col, first_width, growth, max_width)
    return classes.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(
    docs: DataFrame,
    shared: Shared,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_width: int = 256,
    growth: int = 4,
    max_width: int = 1 << 20,
) -> DataFrame:
    """The documents that stay, with all their columns. Cases as in ``exact_classes``."""
    base = shared.table(tagged(docs))
    classes = _classes(base, shared, id_col, text_col, first_width, growth, max_width)
    gone = shared.table(classes.where("not kept").select("row"))
    return base.join(gone, "row", "left_anti").select("record.*")


def _classes(
    base: DataFrame, shared: Shared, id_col: str, text_col: str, first_width: int, growth: int, max_width: int
) -> DataFrame:
    squeezed = F.regexp_replace(record_text(text_col), BLANKS, "")
    live = base.select("row", F.lit(0).cast("long").alias("grp"), squeezed.cast("binary").alias("norm"))
    begin, width = 1, first_width
    ended: list[DataFrame] = []
    while True:
        cut = live.withColumn("bytes", F.substring("norm", begin, width))
        groups = shared.table(
            cut.groupBy("grp", "bytes")
            .agg(F.count("*").alias("n"), F.min("row").alias("next"))
            .where("n > 1")
            .drop("n")
        )
        full = F.octet_length("bytes") == width
        split = shared.table(
            cut.join(groups, ["grp", "bytes"]).select(
                "row", F.col("next").alias("grp"), full.alias("goes_on"), F.when(full, F.col("norm")).alias("norm")
            )
        )
        shared.drop(groups)
        ended.append(split.where("not goes_on").select("row", "grp"))
        live = split.where("goes_on").select("row", "grp", "norm")
        if live.isEmpty():
            break
        begin, width = begin + width, min(width * growth, max_width)

    attributes = base.select(
        "row",
        record_id(id_col).alias("doc_id"),
        F.length(record_text(text_col)).alias("points"),
        F.sha2(squeezed, 256).alias("text_sha256"),
    )
    grouped = reduce(DataFrame.unionAll, ended)
    members = shared.table(grouped.join(attributes.drop("text_sha256"), "row"))
    first = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    kept = shared.table(
        members.groupBy("grp")
        .agg(first.alias("first"), F.count("*").alias("group_size"))
        .select("grp", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    )
    decided = members.join(kept, "grp").select("row", "keep_id", "keep_row", "group_size")
    alone = F.col("keep_row").isNull()
    return attributes.drop("points").join(decided, "row", "left").select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )
