"""Benchmark decontamination by q-gram filtering and banded alignment.

Benchmark texts are cut into passages: the whole and overlapping windows. A passage of m characters that occurs in
a document with at most k edits shares at least ``m - q + 1 - k * q`` of its
q-grams with it (the q-gram lemma), all within a band of diagonals no wider than
k. Diagonals are dealt into bands that overlap by half, so one band holds them
all; bands with enough shared q-grams are verified by an alignment in the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, LongType

from opsmetrics.llm.common import id_text

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 22
#: Documents are searched together up to so many characters, a longer one alone.
_TOGETHER = 1 << 20
#: So many passages of one length are aligned at once.
_ALIGNED = 4096
#: So many hits of q-grams, and so many compared q-grams, are held at once.
_HITS, _COMPARED = 1 << 20, 1 << 22


def fold(text: str) -> np.ndarray:
    """Code points of letters and digits in lower case; runs of all else are one blank, none at the ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    folded = np.where(points < 0x10000, _folding()[points & 0xFFFF], points)
    apart = folded == 32
    folded = folded[~(apart & np.concatenate(([True], apart[:-1])))] if len(folded) else folded
    return folded[:-1] if len(folded) and folded[-1] == 32 else folded


_FOLDING: list[np.ndarray] = []


def _folding() -> np.ndarray:
    if not _FOLDING:
        table = np.full(0x10000, 32, dtype=np.uint32)
        for point in range(0x10000):
            char = chr(point)
            if char.isalnum():
                low = char.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _FOLDING.append(table)
    return _FOLDING[0]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram."""
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    out = codes[: len(codes) - q + 1].astype(np.uint64)
    for k in range(1, q):
        out = out * _FACTOR + codes[k : len(codes) - q + 1 + k]
    return (out ^ (out >> np.uint64(29))) * _FACTOR


def banded_distances(passages: np.ndarray, codes: np.ndarray, lows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each passage and a part of ``codes``, on diagonals low to low + width - 1.

    The passages, a row each, are of one length. Returns the edits and the places in
    ``codes`` after the parts. Diagonal d aligns passage place i with place i + d.
    """
    size = passages.shape[1]
    beyond = size + width + 1
    steps = np.arange(width)
    places = lows[:, None] + steps
    row = np.where((places >= 0) & (places <= len(codes)), 0, beyond)
    for i in range(size):
        at = places + i  # the document character that a match on this diagonal uses
        inside = (at >= 0) & (at < len(codes))
        same = inside & (codes.take(at, mode="clip") == passages[:, i, None])
        row_next = np.where(inside, row + ~same, beyond)
        row_next[:, :-1] = np.minimum(row_next[:, :-1], row[:, 1:] + 1)  # the passage character is missing in the document
        row_next[(at < -1) | (at >= len(codes))] = beyond
        row = np.minimum.accumulate(row_next - steps, axis=1) + steps  # more document characters
    best = row.argmin(axis=1)
    nth = np.arange(len(row))
    return row[nth, best], places[nth, best] + size


@dataclass(frozen=True)
class Passages:
    """One block of benchmark passages with their q-gram index."""

    items: tuple[int | None, ...]
    codes: tuple[np.ndarray, ...]
    q: int
    edit_share: float

    def index(self) -> "PassageIndex":
        key = id(self)
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = (self, PassageIndex(self))
        return _INDEXES[key][1]


_INDEXES: dict[int, tuple[Passages, "PassageIndex"]] = {}


class PassageIndex:
    """The rarest q-grams of the distinct passages and where they occur.

    A match leaves ``needed`` of a passage's ``n`` q-grams whole, so of any
    ``n - needed + enter`` it leaves ``enter``. Only that many are looked up, the rarest
    of the block: a phrase that many passages hold is no way into any of them. Bands with
    ``enter`` of these have all their q-grams counted.
    """

    def __init__(self, block: Passages):
        self.block, q = block, block.q
        owners: dict[bytes, list[int]] = {}
        for nth, own in enumerate(block.codes):
            owners.setdefault(own.astype("<u4").tobytes(), []).append(nth)
        self.owners = list(owners.values())  # equal passages are searched as one
        self.codes = [block.codes[nth[0]] for nth in self.owners]
        size = np.array([len(c) for c in self.codes], dtype=np.int64)
        # no more edits than leave one shared q-gram; a passage shorter than a q-gram must occur exactly
        self.edits = np.maximum(np.minimum((size * block.edit_share).astype(np.int64), (size - q) // q), 0)
        self.needed = size - q + 1 - self.edits * q
        self.enter = np.maximum(self.needed // 2, 1)
        self.short = np.flatnonzero(size < q)
        self.longest = int(size.max(initial=0))
        self.band = int(2 * (self.edits.max(initial=0) + 1))
        self.hashes = [gram_hashes(c, q) for c in self.codes]
        flat = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        many = np.array([len(h) for h in self.hashes], dtype=np.int64)
        owner = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
        _, kind, common = np.unique(flat, return_inverse=True, return_counts=True)
        rarest = np.lexsort((place, common[kind], owner))  # by passage, then from rare to common
        rank = np.empty(len(flat), dtype=np.int64)
        rank[rarest] = place  # the places of a passage are 0, 1, 2, ... in the flat order
        chosen = np.flatnonzero(rank < (many - self.needed + self.enter)[owner])
        chosen = chosen[np.argsort(flat[chosen], kind="stable")]
        self.owner, self.place = owner[chosen], place[chosen]
        self.grams, self.first, self.count = np.unique(flat[chosen], return_index=True, return_counts=True)
        self.slots = np.zeros(1 << _SLOT_BITS, dtype=bool)  # which grams can be there at all
        self.slots[self.grams >> np.uint64(64 - _SLOT_BITS)] = True

    def _bands(self, hashes: np.ndarray, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passages, first diagonals) of the bands that hold enough chosen q-grams, a bounded stretch of text at a time."""
        maybe = np.flatnonzero(self.slots[hashes >> np.uint64(64 - _SLOT_BITS)])
        if not len(maybe) or not len(self.grams):
            return
        nth = np.searchsorted(self.grams, hashes[maybe])
        hit = nth < len(self.grams)
        hit[hit] = self.grams[nth[hit]] == hashes[maybe[hit]]
        at, nth = maybe[hit], nth[hit]
        total = np.concatenate(([0], np.cumsum(self.count[nth])))
        reach = self.longest + self.band  # the places of one band are no further apart, and no diagonal is below -reach
        n_bands = (len(hashes) + self.block.q + reach + self.band) // half + 3
        begin = 0
        while begin < len(at):
            end = max(int(np.searchsorted(total, total[begin] + _HITS)), int(np.searchsorted(at, at[begin] + 2 * reach)))
            end = min(end, len(at))
            some, times = nth[begin:end], self.count[nth[begin:end]]
            entry = np.repeat(self.first[some] - (total[begin:end] - total[begin]), times)
            entry += np.arange(len(entry))
            owner = self.owner[entry]
            slot = owner * n_bands + (np.repeat(at[begin:end], times) - self.place[entry] + reach) // half
            slot, shared = np.unique(slot, return_counts=True)
            follows = np.append(slot[1:] == slot[:-1] + 1, False)
            both = shared + np.where(follows, np.append(shared[1:], 0), 0)  # a band is two neighbouring halves
            alone = np.concatenate(([True], ~follows[:-1]))  # no half before: that band holds this half only
            bands = np.concatenate((slot, slot[alone] - 1))
            held = np.concatenate((both, shared[alone]))
            enough = held >= self.enter[np.concatenate((slot, slot[alone])) // n_bands]
            yield bands[enough] // n_bands, (bands[enough] % n_bands) * half - reach
            # a band that goes on beyond this stretch is whole in the next one
            begin = int(np.searchsorted(at, at[end] - reach)) if end < len(at) else end

    def regions(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passages, first diagonals) of the bands that share enough q-grams; passages of one length at a time."""
        hashes = gram_hashes(codes, self.block.q)
        half = self.band // 2
        steps = np.arange(2 * half)
        for passage, low in self._bands(hashes, half):
            sizes = np.array([len(h) for h in self.hashes], dtype=np.int64)[passage]
            for size in np.unique(sizes):
                same = np.flatnonzero(sizes == size)
                for some in np.array_split(same, -(-len(same) * size * len(steps) // _COMPARED)):
                    own = np.stack([self.hashes[p] for p in passage[some]])
                    shared = np.zeros(len(some), dtype=np.int64)
                    for step in steps:
                        at = (low[some] + step)[:, None] + np.arange(size)
                        inside = (at >= 0) & (at < len(hashes))
                        shared += (inside & (hashes.take(at, mode="clip") == own)).sum(axis=1)
                    enough = some[shared >= self.needed[passage[some]]]
                    if len(enough):
                        yield passage[enough], low[enough]

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, place after it, edits), the best of each passage and place."""
        best: dict[tuple[int, int], int] = {}
        for passages, lows in self.regions(codes):
            for begin in range(0, len(passages), _ALIGNED):
                some = passages[begin : begin + _ALIGNED]
                own = np.stack([self.codes[p] for p in some])
                edits, ends = banded_distances(own, codes, lows[begin : begin + _ALIGNED], self.band)
                for p, e, end in zip(some.tolist(), edits.tolist(), ends.tolist()):
                    if e <= self.edits[p]:
                        best[p, end] = min(best.get((p, end), e), e)
        for passage in self.short:
            own = self.codes[passage]
            if len(own):
                windows = np.lib.stride_tricks.sliding_window_view(codes, len(own)) if len(codes) >= len(own) else []
                for at in np.flatnonzero((windows == own).all(axis=1)) if len(windows) else []:
                    left, right = at - 1, at + len(own)
                    if (left < 0 or codes[left] == 32) and (right >= len(codes) or codes[right] == 32):
                        best[(int(passage), int(right))] = 0
        return [(p, end, edits) for (p, end), edits in best.items()]


def cut_passages(codes: np.ndarray, longest: int, window: int) -> list[np.ndarray]:
    """The whole or, if over ``longest``, parts of equal length; then windows that overlap by half, the last at the end.

    Any ``window + window // 2 - 1`` characters in a row hold a whole window.
    """
    parts = -(-len(codes) // longest)
    whole = [p for p in np.array_split(codes, parts)] if parts else []
    if len(codes) <= window:
        return whole
    last = len(codes) - window
    starts = [*range(0, last, max(window // 2, 1)), last]
    return whole + [codes[s : s + window] for s in starts]


def passage_blocks(
    benchmark: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    q: int = 8,
    edit_share: float = 0.05,
    longest: int = 400,
    window: int = 64,
    block_chars: int = 2_000_000,
) -> list[Passages]:
    """All benchmark texts as passages, in blocks of about ``block_chars`` characters.

    An item counts whole and in windows of ``window`` folded characters at every half
    of that, so a document that copies any 95 characters in a row of an item (with
    ``window`` 64) is found, and one that copies less than a window of a longer item
    is not. An item no longer than a window counts whole only. Blocks are read one after the other, each bounded; the benchmark is the stated
    query set. Null and empty texts give no passage.
    """
    items = id_text(benchmark, item_col, text_col).orderBy("doc_id", "text")
    blocks: list[Passages] = []
    names: list[int | None] = []
    codes: list[np.ndarray] = []
    size = 0

    def close() -> None:
        nonlocal names, codes, size
        if codes:
            blocks.append(Passages(tuple(names), tuple(codes), q, edit_share))
        names, codes, size = [], [], 0

    for row in items.toLocalIterator():
        for part in cut_passages(fold(row["text"]), longest, window):
            names.append(row["doc_id"])
            codes.append(part)
            size += len(part)
            if size >= block_chars:
                close()
    close()
    return blocks


def find_leaks(
    docs: DataFrame,
    blocks: list[Passages],
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """A row per document: ``contaminated``, ``item_ids`` (sorted), ``n_passages`` and ``edits`` (fewest of a match).

    Case, punctuation and runs of blanks do not count. A document is contaminated
    if a whole passage occurs in it within the edit budget (see ``passage_blocks``
    for the passages of an item; ``n_passages`` counts them). Null and empty texts
    are clean; a passage shorter than a q-gram must occur exactly, between
    blanks. Items without id count, but name nothing. Rows that repeat an id are
    judged each. Without passages every document is clean; an empty table gives
    no rows. With ``carry`` the struct ``record`` holds the document's columns.
    """
    spark = docs.sparkSession
    own = id_text(docs, id_col, text_col, carry)
    sent = [spark.sparkContext.broadcast(b) for b in blocks]  # each bounded by block_chars

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[tuple[int | None, int]]] = [[] for _ in range(batch.num_rows)]
            for block in sent:
                index = block.value.index()
                gap = np.zeros(index.band + block.value.q, dtype=np.uint32)  # code 0 is in no passage
                docs_, codes, size = [], [], 0

                def flush() -> None:
                    if not docs_:
                        return
                    starts = np.concatenate(([0], np.cumsum([len(c) + len(gap) for c in codes])))
                    joined = np.concatenate([x for c in codes for x in (c, gap)])
                    for passage, end, edits in index.matches(joined):
                        doc = docs_[int(np.searchsorted(starts, end - 1, side="right")) - 1]
                        found[doc].extend((block.value.items[own], own, edits) for own in index.owners[passage])

                for i, text in enumerate(batch.column("text")):
                    folded = fold(text.as_py())
                    docs_.append(i)
                    codes.append(folded)
                    size += len(folded)
                    if size >= _TOGETHER:
                        flush()
                        docs_, codes, size = [], [], 0
                flush()
            items = [sorted({x[0] for x in f if x[0] is not None}) for f in found]
            columns = [
                pa.array([bool(f) for f in found]),
                pa.array(items, pa.list_(pa.int64())),
                pa.array([len({x[1] for x in f}) for f in found], pa.int64()),
                pa.array([min((x[2] for x in f), default=None) for f in found], pa.int64()),
            ]
            kept = ["doc_id", *(["record"] if carry else [])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + columns, names=[*kept, "contaminated", "item_ids", "n_passages", "edits"]
            )

    schema = own.select("doc_id", *(["record"] if carry else [])).schema
    for name, kind in (
        ("contaminated", BooleanType()),
        ("item_ids", ArrayType(LongType())),
        ("n_passages", LongType()),
        ("edits", LongType()),
    ):
        schema = schema.add(name, kind)
    return own.mapInArrow(search, schema)
