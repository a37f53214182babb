"""Sheets read by many tasks, with the row number each row has in the sheet.

A CSV file whose quoted values hold line breaks cannot be cut at any line break:
only those outside quotes end a record. A line break is outside if the quotes
before it, from the start of the file, are even in number. So:

1. each split of a file counts its quotes, and the records that end in it for
   either state at its start;
2. a running sum over the splits of a file settles the state at the start of each,
   and the number of its first record;
3. each split cuts its lines into records. What it holds of a record that began
   before it, or ends after it, is a fragment; fragments of one record are joined.

The driver sees a row for each split, as many as it has planned to read anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDINAL = "_ordinal"
#: Options under which line breaks and quotes are not those the splits look for.
OWN_PARSING = {"quote", "escape", "linesep", "encoding", "charset", "comment", "header", "multiline", "chartoescapequoteescaping"}
_LINE = ["value", "_file", "_block"]


class _Split(NamedTuple):
    """Where a split begins: whether inside quotes, and with which record."""

    inside: bool
    record: int  # number in its file; 0 is the header
    offset: int  # records of earlier files, headers aside
    place: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of a batch by split; a task reads one split after the other."""
    file, block = batch.column(1), batch.column(2)
    codes = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = block.to_numpy(zero_copy_only=False)
    change = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
    for a, b in zip([0, *change], [*change, batch.num_rows]):
        if b > a:
            yield (file[int(a)].as_py(), int(starts[a])), batch.column(0).slice(a, b - a)


def _quotes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quotes up to and with each line, and whether the line is empty."""
    counts = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
    blank = pc.is_in(lines, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
    return np.cumsum(counts), blank


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: quotes, and records that end in it, if it begins outside and inside quotes."""
    seen: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for split, lines in _runs(batch):
            quotes, *ends = seen.setdefault(split, [0, 0, 0])
            after, blank = _quotes(lines)
            after = after + quotes
            before = np.concatenate(([quotes], after[:-1]))
            for inside in (0, 1):
                ended = ((after + inside) % 2 == 0) & ~(blank & ((before + inside) % 2 == 0))
                ends[inside] += int(ended.sum())
            seen[split] = [int(after[-1]), *ends]
    keys = list(seen)
    columns = [[k[0] for k in keys], [k[1] for k in keys], *([seen[k][i] for k in keys] for i in range(3))]
    kinds = [pa.string(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["_file", "_block", "quotes", "outside", "inside"]
    )


def _plan(summaries: list) -> dict[tuple[str, int], _Split]:
    """The start of each split, by running over the splits of each file in order."""
    plan, offset, previous = {}, 0, None
    inside, record = False, 0
    for place, s in enumerate(sorted(summaries, key=lambda s: (s["_file"], s["_block"]))):
        if s["_file"] != previous:
            offset += max(record + inside - 1, 0)  # a value left open ends with its file
            previous, inside, record = s["_file"], False, 0
        plan[s["_file"], s["_block"]] = _Split(inside, record, offset, place)
        record += s["inside"] if inside else s["outside"]
        inside = bool((s["quotes"] + inside) % 2)
    return plan


def _cut(plan: dict[tuple[str, int], _Split]):
    """Lines to records and fragments of records: number of the row, place of the split, whether whole, text."""

    def of_split(split: _Split, lines: Iterator[pa.Array]) -> Iterator[tuple[int, int, bool, str]]:
        record, head, quotes, held = split.record, split.inside, int(split.inside), []

        def piece(text: str, whole: bool) -> tuple[int, int, bool, str]:
            return split.offset + record - 1, split.place, whole, text

        for part in lines:
            after, blank = _quotes(part)
            open_after = ((after + quotes) % 2).tolist()
            quotes += int(after[-1])
            for text, still_open, empty in zip(part.to_pylist(), open_after, blank.tolist()):
                if still_open:
                    held.append(text)
                    continue
                if empty and not held and not head:
                    continue
                whole, held = "\n".join([*held, text]), []
                if record:
                    yield piece(whole.removesuffix("\r"), not head)
                record, head = record + 1, False
        if (held or head) and record:
            yield piece("\n".join(held), False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bool, str]] = []

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[ORDINAL, "place", "whole", "text"])

        runs = ((key, lines) for batch in batches for key, lines in _runs(batch))
        ahead = next(runs, None)
        while ahead is not None:
            key = ahead[0]

            def own() -> Iterator[pa.Array]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:  # noqa: B023
                    yield ahead[1]
                    ahead = next(runs, None)

            for row in of_split(plan[key], own()):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield batch_of()
                    rows.clear()
        if rows:
            yield batch_of()

    return cut


def read_quoted_csv(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """CSV with a header in each file, all columns as text, plus ``_ordinal``: 0, 1, 2, ... in the order of files and rows.

    Values with quotes, separators or line breaks are quoted and quotes in them
    doubled, as spreadsheets and ``export_csv`` write them; then the rows are those
    of Spark's own multi-line reader. Lines end with LF or CRLF; in values both stay as
    they are (that reader makes LF of CRLF in files whose lines end so). Empty lines
    between records are no rows. Files are read twice: once for the quotes, once for the rows.
    """
    names = spark.read.options(header="true", inferSchema="false", escape='"', multiLine="true", **(options or {})).csv(path).columns
    lines = _lines(spark, path)
    summaries = lines.mapInArrow(_summaries, "_file string, _block long, quotes long, outside long, inside long").collect()
    plan = _plan(summaries)
    pieces = lines.mapInArrow(_cut(plan), f"{ORDINAL} long, place int, whole boolean, text string")
    joined = (
        pieces.where("not whole")  # at most two of a split
        .groupBy(ORDINAL)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "\n").alias("text"))
        .select(ORDINAL, F.regexp_replace("text", "\r$", "").alias("text"))
    )
    records = pieces.where("whole").select(ORDINAL, "text").unionByName(joined)
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("text", fields, {"escape": '"', "multiLine": "true", **(options or {})})
    return records.select(ORDINAL, parsed.alias("row")).select(
        *(F.col(f"row.c{i}").alias(name) for i, name in enumerate(names)), ORDINAL
    )


def number_rows(df: DataFrame) -> DataFrame:
    """``df``, as read from files, with ``_ordinal``: 0, 1, 2, ... in the order of files and rows.

    Two passes: rows are counted by split, and a running sum over the splits
    gives each its first number, however the files are cut. A row for each split
    is broadcast, as many as the scan has.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_many"), F.min("_id").alias("_first"))
    before = F.sum("_many").over(Window.orderBy("_file", "_block")) - F.col("_many")
    starts = splits.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(starts), ["_file", "_block"]).select(
        *(F.col(f"`{c}`") for c in df.columns), (F.col("_id") + F.col("_shift")).alias(ORDINAL)
    )
