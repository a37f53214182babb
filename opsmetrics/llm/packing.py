"""Packing documents into token sequences by linear grouping.

The sizes of all pieces are integers from 1 to the capacity, so a histogram with
at most ``capacity`` rows describes them completely. The driver plans on that
histogram alone (its size never grows with the input):

1. large sizes are put into groups of equal cardinality and rounded up to the
   largest size of their group (the linear grouping scheme);
2. the few rounded sizes are packed by configurations from the cutting-stock
   linear program, solved by column generation, rounded down;
3. the actual pieces take the slots of their group, which leaves gaps;
4. what the rounding left over and the small pieces go best-fit into the gaps.

Runs of equal sequences stay one entry of the plan, so a plan line says: the
pieces of this size with these ranks go to these sequences at this offset.
Executors rank the pieces of each size and look their places up.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared, id_text

#: Two blanks that meet.
_RUN = re.compile(r"\s\s")
#: The pattern that a byte-level vocabulary splits by, for texts without such runs.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: A configuration must be worth so much more than one sequence to enter the linear program.
_TOLERANCE = 1e-3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


class TokenIds:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    A byte-level vocabulary whose ids follow the order of its merges is the same
    thing as a table of ranks. ``tiktoken`` reads that several times as fast, with the
    byte-level pattern less its look-ahead: the look-ahead only matters where two
    blanks meet, and a text with such a place is encoded by ``tokenizers`` itself,
    as is every text if the vocabulary is of another kind. With ``added`` the strings
    of added tokens are one id each, as ``tokenizers`` has it by default, and texts
    that hold one go to it too; without, they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added
        self.ranked = _ranked(path)
        own = [t.content for t in self.whole.get_added_tokens_decoder().values()] if added else []
        self.apart = re.compile("|".join([_RUN.pattern, *map(re.escape, own)]))

    def ids(self, text: str) -> bytes:
        if self.ranked is not None and not self.apart.search(text):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def _ranked(path: str):
    """The vocabulary as ranks, or None if it isn't byte-level with ids in the order of the merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if (
        model.get("type", "BPE") != "BPE"
        or spec.get("normalizer")
        or {**plain, **before, "trim_offsets": None} != {**plain, "trim_offsets": None}
        or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    ):
        return None
    # printable bytes stand for themselves, the others for the code points from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    own = [model["vocab"].get(m, -1) for m in merged]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    except KeyError:
        return None
    if own != sorted(set(own)) or len(ranks) != 256 + len(own) or sorted(ranks.values()) != list(range(len(ranks))):
        return None
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` from the end if longer.

    ``part`` is the task, ``local_rank`` counts the pieces of one length within it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TokenIds(tokenizer_path, added=True)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.ids(text.as_py()) + end
                total = len(ids) // 4
                first = total % capacity or capacity
                bounds = [0, *range(first, total, capacity), total]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rank = seen.get(b - a, 0)
                    seen[b - a] = rank + 1
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, rank))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: how often each size occurs in it."""
    best = np.zeros(capacity + 1)
    stages = [best]
    for size, value in zip(sizes.tolist(), values.tolist()):
        more = best.copy()
        for k in range(1, capacity // size + 1 if value > 0 else 1):
            np.maximum(more[k * size :], best[: capacity + 1 - k * size] + k * value, out=more[k * size :])
        stages.append(best := more)
    counts = np.zeros(len(sizes), dtype=np.int64)
    room = capacity
    for i in range(len(sizes) - 1, -1, -1):
        without = stages[i]
        copies = np.arange(room // sizes[i] + 1)
        worth = without[room - copies * sizes[i]] + copies * values[i]
        counts[i] = int(worth.argmax()) if values[i] > 0 else 0
        room -= int(counts[i] * sizes[i])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of configurations from the cutting-stock linear program, rounded down.

    Column generation: the duals of the current basis price all configurations
    by a knapsack; the best one enters until none saves more than a small share.
    """
    base = np.diag(capacity // sizes).astype(float)
    amount = demand / np.diag(base)
    for _ in range(20 * len(sizes)):
        duals = np.linalg.solve(base.T, np.ones(len(sizes)))
        worth, column = _knapsack(sizes, duals, capacity)
        if worth <= 1 + _TOLERANCE:
            break
        change = np.linalg.solve(base, column.astype(float))
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * change, 0)
        amount[out] = ratio[out]
        base[:, out] = column
    left = demand.astype(np.int64).copy()
    runs = []
    for times, column in zip(np.floor(amount + 1e-9).astype(np.int64), base.T.astype(np.int64)):
        used = column > 0
        if used.any():
            times = min(int(times), int((left[used] // column[used]).min()))
            if times > 0:
                left -= times * column
                runs.append((times, column))
    return runs


class _Plan:
    """Runs of equal sequences, by gap, and the places given so far."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sequences = 0
        self.lines: list[tuple[int, int, int, int, int]] = []  # size, first rank, count, first sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap: first sequence and count of each run
        self.gaps: list[int] = []  # sorted keys of open

    def new(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def keep(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in self.open:
                self.open[gap] = []
                insort(self.gaps, gap)
            self.open[gap].append((first, count))

    def fill(self, size: int, rank: int, count: int, gap: int, first: int, room: int) -> int:
        """Puts pieces of one size into a run of ``room`` sequences; returns how many."""
        each = gap // size
        whole = min(room, count // each)
        for k in range(each if whole else 0):
            self.lines.append((size, rank + k * whole, whole, first, self.capacity - gap + k * size))
        self.keep(gap - each * size, first, whole)
        done = whole * each
        if whole < room:
            rest = min(count - done, each)  # fewer than one sequence takes
            if rest:
                for k in range(rest):
                    self.lines.append((size, rank + done + k, 1, first + whole, self.capacity - gap + k * size))
                self.keep(gap - rest * size, first + whole, 1)
                done += rest
                whole += 1
            self.keep(gap, first + whole, room - whole)
        return done

    def best_fit(self, size: int, rank: int, count: int) -> None:
        """The tightest gaps first, then new sequences."""
        while count:
            at = bisect_left(self.gaps, size)
            if at < len(self.gaps):
                gap = self.gaps[at]
                first, room = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap], self.gaps[at]
            else:
                gap, room = self.capacity, -(-count // (self.capacity // size))
                first = self.new(room)
            done = self.fill(size, rank, count, gap, first, room)
            rank, count = rank + done, count - done


def plan_packing(histogram: dict[int, int], capacity: int, groups: int = 128, small_share: int = 8) -> tuple[list, int]:
    """Places for all pieces of a histogram: lines and the number of sequences.

    Sizes over ``capacity / small_share`` are large. ``groups`` bounds the number
    of rounded sizes; neither depends on how many pieces there are.
    """
    plan = _Plan(capacity)
    counts = {s: n for s, n in histogram.items() if n}
    queue = [[s, 0, n] for s, n in sorted(counts.items(), reverse=True)]  # size, next rank, left
    full = [q for q in queue if q[0] == capacity]
    large = [q for q in queue if capacity > q[0] > capacity // small_share]
    small = [q for q in queue if q[0] <= capacity // small_share]
    for size, rank, n in full:
        plan.lines.append((size, rank, n, plan.new(n), 0))

    total = sum(n for _, _, n in large)
    members: list[list[list[int]]] = []  # of each group: size, next rank, left
    if total:
        bounds = sorted({round(total * k / groups) for k in range(1, groups + 1)} - {0})
        passed, at = 0, 0
        group: list[list[int]] = []
        for size, rank, n in large:
            while n:
                take = min(n, bounds[at] - passed)
                group.append([size, rank, take])
                rank, n, passed = rank + take, n - take, passed + take
                if passed == bounds[at]:
                    members.append(group)
                    group, at = [], at + 1
    rounded: dict[int, list[list[int]]] = {}
    for group in members:  # groups with one rounded size are one size
        rounded.setdefault(group[0][0], []).extend(group)
    if rounded:
        sizes = np.array(list(rounded), dtype=np.int64)
        demand = np.array([sum(n for _, _, n in g) for g in rounded.values()], dtype=np.int64)
        pieces = [sorted(g, key=lambda q: -q[0]) for g in rounded.values()]
        for times, column in configurations(sizes, demand, capacity):
            slots = [i for i, k in enumerate(column) for _ in range(int(k))]
            first = plan.new(times)
            # the actual pieces of a group take its slots; a run ends where a slot's size changes
            taken: list[list[tuple[int, int, int]]] = []
            for i in slots:
                need, parts = times, []
                while need:
                    q = pieces[i][0]
                    n = min(need, q[2])
                    parts.append((q[0], q[1], n))
                    q[1], q[2], need = q[1] + n, q[2] - n, need - n
                    if not q[2]:
                        pieces[i].pop(0)
                taken.append(parts)
            cuts = sorted({c for parts in taken for c in np.cumsum([n for _, _, n in parts]).tolist()})
            begin = 0
            heads = [(0, 0)] * len(taken)  # part and how much of it is used
            for cut in cuts:
                offset, run = 0, cut - begin
                for k, parts in enumerate(taken):
                    part, used = heads[k]
                    size, rank, n = parts[part]
                    plan.lines.append((size, rank + used, run, first + begin, offset))
                    offset += size
                    heads[k] = (part + 1, 0) if used + run == n else (part, used + run)
                plan.keep(capacity - offset, first + begin, run)
                begin = cut
        left = sorted((q for g in pieces for q in g if q[2]), key=lambda q: (-q[0], q[1]))
    else:
        left = []
    for size, rank, n in left + small:
        plan.best_fit(size, rank, n)
    return plan.lines, plan.sequences


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: int = 128,
    shared: Shared | None = None,
) -> DataFrame:
    """A row per piece with its sequence and its place there.

    A null or empty text is one piece with the end id alone. Rows with equal ids
    or null ids are separate documents. An empty table gives no rows. Texts are
    encoded whole, whatever their length. Ties between equal sizes are settled by
    the order of the rows in the tasks; any choice gives as many sequences.
    """
    shared = shared or Shared(docs.sparkSession, "packing")
    pieces = shared.table(token_pieces(id_text(docs, id_col, text_col), tokenizer_path, capacity))
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most `capacity` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lines, _ = plan_packing(histogram, capacity, groups)
    table = np.array(sorted(lines), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            line = table[np.searchsorted(keys, (size << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(line[:, 3] + rank - line[:, 1]),
                    pa.array(line[:, 4]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(starts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank")
    )
    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
