"""Helpers shared by the operators: input columns, shared tables, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Only the id and the text, renamed, so extra columns never clash with those an operator adds.

    A null text counts as empty. With ``carry`` the struct ``record`` holds the whole row.
    """
    record = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("record")] if carry else []
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *record,
    )


def tagged(docs: DataFrame) -> DataFrame:
    """Each row whole, as the struct ``record``, with a number of its own.

    Other columns can have any name. The numbers hold once the result is written.
    """
    record = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    return docs.select(F.monotonically_increasing_id().alias("row"), record.alias("record"))


def record_id(id_col: str):
    return F.col("record").getField(id_col).cast("long")


def record_text(text_col: str):
    return F.coalesce(F.col("record").getField(text_col).cast("string"), F.lit(""))


#: Whether Spark deletes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Shared:
    """Tables in a database of their own, in the folder that driver and executors share.

    They cut the lineage: what reads one survives the loss of any executor.
    ``drop`` deletes tables that nothing reads any more, ``close`` all of them.
    With ``tidy`` the shuffle files of a table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.names: dict[int, tuple[str, DataFrame]] = {}
        self.count = 0
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{checkpoint_dir(spark).rstrip('/')}/{self.name}'")

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        name = f"{self.name}.t{self.count}"
        before = self.spark.conf.get(_CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.format("parquet").option("compression", "zstd").saveAsTable(name)
        finally:
            if self.tidy and before is None:
                self.spark.conf.unset(_CLEANUP)
            elif self.tidy:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.table(name)
        self.names[id(out)] = (name, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            name, _ = self.names.pop(id(table))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self.names.clear()
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_bucket(col, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus
