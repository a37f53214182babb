"""Removing repeated passages by relative Lempel-Ziv factors over distributed reference blocks.

Documents are factored against a reference that holds all documents with smaller
ids. Only factors of ``length`` words or more matter, so the parse works on cells:

* A window is ``length`` consecutive words. Its smallest hashed run of
  ``anchor_words`` words is its anchor; equal windows have equal anchors, whatever
  surrounds them. The windows in a row with one anchor are a cell.
* The reference index is dealt into blocks by anchor. A document meets, in the
  block of each of its anchors, all reference cells with that anchor.
* A cell that also starts in a smaller document lies inside a factor. It is
  taken whole: one row for each distinct cell holds its smallest document.
* The other cells with a known anchor are where factors begin and end. There the
  factor's boundary is checked window by window.

Adjacent cells and windows that were found make up the factors, and the words
they cover are the duplicate spans. Every step is an aggregate by content with a
partial aggregate first, so a passage that a third of the documents share costs
a row for each of them, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared, id_text
from opsmetrics.llm.words import mix, prefix_sums, range_hash, run_hashes, word_bounds, word_hashes

_PLACE_BITS = 20


def anchors_of(grams: np.ndarray, span: int) -> np.ndarray:
    """For each ``span`` consecutive gram hashes the place of the smallest, the last of equal ones.

    Hashes compare by their upper bits; slices bound the memory.
    """
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    out, step = [], (1 << _PLACE_BITS) - span
    for begin in range(0, len(grams) - span + 1, step):
        part = grams[begin : begin + step + span - 1]
        low = (part & ~mask) | (mask - np.arange(len(part), dtype=np.uint64))
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        out.append((mask - (low & mask)).astype(np.int64) + begin)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cells_of(units: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """First and last window start, anchor hash and content digest of each cell of a sequence of hashes."""
    if len(units) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    grams = run_hashes(units, anchor)
    place = anchors_of(grams, length - anchor + 1)
    own = grams[place]
    low = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))  # by value: a run of one unit is one cell
    high = np.append(low[1:], len(place)) - 1
    at = place[low]
    content = range_hash(prefix_sums(units), low, high + length)
    shape = ((at - low) << 32) + (high - low)
    return low, high, grams[at].view(np.int64), (content ^ mix(shape.astype(np.uint64))).view(np.int64)


_CELL = pa.struct([("low", pa.int32()), ("high", pa.int32()), ("anchor", pa.int64()), ("digest", pa.int64())])
_WINDOW = pa.struct([("place", pa.int32()), ("anchor", pa.int64()), ("hash", pa.int64())])


def lists(kind: pa.StructType, parts: list[tuple[np.ndarray, ...]]) -> pa.ListArray:
    """A list of structs for each row, from its columns."""
    offsets = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int32)
    columns = [
        pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind.field(k).type)
        for k in range(kind.num_fields)
    ]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(kind)))


def _parse(own: DataFrame, length: int, anchor_words: int) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [
                cells_of(word_hashes(t.as_py().encode("utf-8", "surrogatepass")), length, anchor_words)
                for t in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(_CELL, parts)], names=["doc_id", "text_hash", "cells"]
            )

    return own.mapInArrow(
        parse, "doc_id long, text_hash long, cells array<struct<low:int,high:int,anchor:long,digest:long>>"
    )


def _windows(with_cells: DataFrame, length: int) -> DataFrame:
    """Each window of the given cells with its hash."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text, cells in zip(batch.column(2), batch.column(3).to_pylist()):
                sums = prefix_sums(word_hashes(text.as_py().encode("utf-8", "surrogatepass")))
                low = np.array([c["low"] for c in cells], dtype=np.int64)
                times = np.array([c["high"] for c in cells], dtype=np.int64) - low + 1
                place = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                anchor = np.repeat(np.array([c["anchor"] for c in cells], dtype=np.int64), times)
                parts.append((place, anchor, range_hash(sums, place, place + length).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(_WINDOW, parts)], names=["doc_id", "text_hash", "windows"]
            )

    return with_cells.select("doc_id", "text_hash", "text", "cells").mapInArrow(
        hashes, "doc_id long, text_hash long, windows array<struct<place:int,anchor:long,hash:long>>"
    )


def _cut(with_spans: DataFrame) -> DataFrame:
    """Whole texts without the words of the spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                start, end = word_bounds(np.frombuffer(raw, dtype=np.uint8))
                edge = np.zeros(len(start) + 1, dtype=np.int64)
                for span in spans.as_py() or ():
                    edge[span["low"]] += 1
                    edge[span["high"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                change = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                total.append(len(start))
                removed.append(int(gone.sum()))
                runs.append((change[0::2], change[1::2]))
                words = [raw[a:b] for a, b in zip(start[~gone].tolist(), end[~gone].tolist())]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    lists(_SPAN, runs),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return with_spans.select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, spans array<struct<low:int,high:int>>, kept string"
    )


_SPAN = pa.struct([("low", pa.int32()), ("high", pa.int32())])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    anchor_words: int = 8,
) -> DataFrame:
    """A row per document: ``doc_id``, ``n_words``, ``n_removed``, ``spans`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of
    ``length`` words that covers it has the same words as a window that starts in
    a document with a smaller id. Windows are judged on the input. ``spans`` are
    the maximal removed runs in words, ``kept`` the other words joined by a blank.

    Null and empty texts, and texts with fewer than ``length`` words, lose nothing. A
    very long text is read whole, in one task: its arrays take some tens of bytes for each byte.
    Rows with one id are not smaller than each other; a row without id neither
    loses words nor is a reason to remove any. A passage repeated inside one
    document stays there. An empty table gives no rows; other columns are not read.
    """
    shared = Shared(docs.sparkSession, "factors")
    own = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parsed = shared.table(_parse(own, length, anchor_words))
    cells = parsed.where("doc_id is not null").select("doc_id", "text_hash", F.inline("cells"))
    known = shared.table(
        cells.groupBy("anchor").agg(F.min("doc_id").alias("low_id"), F.max("doc_id").alias("high_id"))
        .where("low_id < high_id")
        .select("anchor")
    )
    meeting = shared.table(cells.join(known, "anchor"))
    shared.drop(parsed, known)
    distinct = shared.table(meeting.groupBy("anchor", "digest").agg(F.min("doc_id").alias("first_id")))
    # a table of its own, so that the join that reads it can split a hot anchor
    varied = shared.table(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")))
    judged = shared.table(
        meeting.join(shared.table(distinct.join(varied, "anchor")), ["anchor", "digest"]).select(
            "doc_id", "text_hash", "low", "high", "anchor", (F.col("first_id") < F.col("doc_id")).alias("inside"), "kinds"
        )
    )
    shared.drop(meeting, distinct)
    boundary = (
        judged.where("not inside and kinds > 1")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("low", "high", "anchor")).alias("cells"))  # of one document
    )
    hashed = shared.table(_windows(own.join(shared.table(boundary), ["doc_id", "text_hash"]), length))
    windows = hashed.select("doc_id", "text_hash", F.inline("windows"))
    first = shared.table(
        windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("high_id"))
        .where("first_id < high_id")
        .drop("high_id")
    )
    found = windows.join(first, ["anchor", "hash"]).where("first_id < doc_id")
    spans = (
        judged.where("inside").select("doc_id", "text_hash", "low", (F.col("high") + length).alias("high"))
        .unionAll(found.select("doc_id", "text_hash", F.col("place").alias("low"), (F.col("place") + length).alias("high")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("low", "high")).alias("spans"))  # of one document
    )
    return _cut(own.join(shared.table(spans), ["doc_id", "text_hash"], "left"))
