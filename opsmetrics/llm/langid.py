"""Language identification by cross-parsing entropy.

Per language, a suffix automaton holds the substrings of a bounded sample of
labelled text. A text is parsed against each of them: a phrase is the longest
match from where the last one ended. Few, long phrases mean that the text looks
like that language. ``phrases * log2(sample length) / text length`` (the
cross-parsing estimate of the cross entropy, in bits a character) makes the
counts comparable between samples of different length; the smallest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from opsmetrics.llm.common import id_text

UNDECIDED = "und"
#: Codes: 0 stands for everything between letters; the last two for a letter unknown to the samples and for padding.
_BREAK = 0
#: A text is parsed in blocks of so many characters, side by side; a block's end also ends a phrase.
_BLOCK = 512
#: So many blocks at once, to bound a task's memory.
_LANES = 16_384
#: A sample with more states times signs than this keeps its moves sorted, not in a table.
_DENSE = 8_000_000
#: How sharply the score separates the languages: bits a character count so often.
_SHARPNESS = 4.0


def fold(text: str) -> np.ndarray:
    """Code points in lower case, with one 32 for each run of anything but letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    folded = _folding()[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        distinct, nth = np.unique(points[beyond], return_inverse=True)
        letter = np.array([chr(p).isalpha() for p in distinct.tolist()])
        folded[beyond] = np.where(letter[nth], 0xFFFF, 32)
    apart = folded == 32
    return folded[~(apart & np.concatenate(([True], apart[:-1])))] if len(folded) else folded


_FOLDING: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Lower case of each letter of the basic plane; 32 for what is no letter. Letters beyond it share the code 0xFFFF."""
    if not _FOLDING:
        table = np.full(0x10000, 32, dtype=np.uint16)
        for point in range(0xFFFF):
            char = chr(point)
            if char.isalpha():
                low = char.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _FOLDING.append(table)
    return _FOLDING[0]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``codes``; state 0 starts."""
    moves: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for code in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        size.append(size[last] + 1)
        state = last
        while state >= 0 and code not in moves[state]:
            moves[state][code] = new
            state = link[state]
        if state >= 0:
            target = moves[state][code]
            if size[target] == size[state] + 1:
                link[new] = target
            else:
                clone = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                size.append(size[state] + 1)
                link[target] = link[new] = clone
                while state >= 0 and moves[state].get(code) == target:
                    moves[state][code] = clone
                    state = link[state]
        last = new
    return moves


@dataclass(frozen=True)
class LanguageModel:
    """Samples of folded text per language; small enough to go to every task."""

    samples: tuple[tuple[str, str], ...]

    def parser(self) -> "CrossParser":
        if self.samples not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[self.samples] = CrossParser(self.samples)
        return _PARSERS[self.samples]


_PARSERS: dict[tuple, "CrossParser"] = {}  # built once by each Python worker


class CrossParser:
    """Tables that parse many blocks of text side by side, a character a step."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in samples]
        letters = sorted(set("".join(s for _, s in samples)) - {" "})
        self.unknown, self.pad = len(letters) + 1, len(letters) + 2
        self.code_of = np.full(0x10000, self.unknown, dtype=np.uint16)
        self.code_of[32] = _BREAK
        for code, letter in enumerate(letters, 1):
            self.code_of[ord(letter)] = code
        self.bits = np.array([np.log2(max(len(s), 2)) for _, s in samples])
        self.moves = [self._moves([int(self.code_of[ord(c)]) for c in s]) for _, s in samples]

    def _moves(self, codes: list[int]) -> "DenseMoves | SortedMoves":
        moves = suffix_automaton(codes)
        signs = np.array(sorted({_BREAK, *codes}))
        own = np.full(self.pad + 1, len(signs), dtype=np.uint16)  # signs that the sample lacks are one
        own[signs] = np.arange(len(signs))
        own[self.pad] = len(signs) + 1
        local = [{int(own[code]): to for code, to in row.items()} for row in moves]
        kind = DenseMoves if len(moves) * (len(signs) + 2) <= _DENSE else SortedMoves
        return kind(local, own, len(signs) + 2)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language."""
        counts = np.zeros((len(texts), len(self.moves)), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // _BLOCK) for t in texts])
        block = np.concatenate([np.arange(-(-len(t) // _BLOCK)) for t in texts] or [np.zeros(0, int)])
        for begin in range(0, len(owner), _LANES):
            own, nth = owner[begin : begin + _LANES], block[begin : begin + _LANES]
            lanes = np.full((len(own), _BLOCK), self.pad, dtype=np.uint16)
            for lane, (doc, k) in enumerate(zip(own, nth)):
                part = texts[doc][k * _BLOCK : (k + 1) * _BLOCK]
                lanes[lane, : len(part)] = self.code_of[part]
            steps = np.ascontiguousarray(lanes.T)
            for language, moves in enumerate(self.moves):
                ended = moves.ends(steps) + 1  # and the phrase that the block's end ends
                counts[:, language] += np.bincount(own, weights=ended, minlength=len(texts)).astype(np.int64)
        return counts


class DenseMoves:
    """A suffix automaton as a table of states and the signs of its own sample."""

    def __init__(self, moves: list[dict[int, int]], own: np.ndarray, width: int):
        """``own`` turns the parser's codes into the sample's; its last two signs are the unknown and the padding."""
        self.own = own
        # for state and sign: twice the next state's row, plus 1 where a phrase ends before the sign
        restart = np.ones(width, dtype=np.int64)  # a sign that the sample lacks is a phrase of its own
        for sign, state in moves[0].items():
            restart[sign] = 2 * state * width + 1
        table = np.tile(restart, (len(moves), 1))
        for state, row in enumerate(moves):
            for sign, to in row.items():
                table[state, sign] = 2 * to * width
        table[:, width - 1] = 2 * width * np.arange(len(moves))
        self.table = table.astype(np.int32 if table.max() < 2**31 else np.int64).ravel()

    def ends(self, steps: np.ndarray) -> np.ndarray:
        """How often a phrase ends in each lane; ``steps`` holds a code of every lane a row."""
        row = np.zeros(steps.shape[1], dtype=self.table.dtype)
        ended = np.zeros(steps.shape[1], dtype=np.int64)
        for codes in steps:
            got = self.table.take(row + self.own.take(codes))
            ended += got & 1
            row = got >> 1
        return ended


class SortedMoves:
    """A suffix automaton with thousands of signs: only the moves that there are, sorted by state and sign."""

    def __init__(self, moves: list[dict[int, int]], own: np.ndarray, width: int):
        self.own, self.width = own, width
        keys = np.array([state * width + sign for state, row in enumerate(moves) for sign in row], dtype=np.int64)
        to = np.array([to for row in moves for to in row.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.restart = np.zeros(width, dtype=np.int64)  # a sign that the sample lacks is a phrase of its own
        for sign, state in moves[0].items():
            self.restart[sign] = state

    def ends(self, steps: np.ndarray) -> np.ndarray:
        """As in ``DenseMoves``."""
        state = np.zeros(steps.shape[1], dtype=np.int64)
        ended = np.zeros(steps.shape[1], dtype=np.int64)
        for codes in steps:
            signs = self.own.take(codes)
            key = state * self.width + signs
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known, text = self.keys[at] == key, signs != self.width - 1
            ended += text & ~known
            state = np.where(known, self.to[at], np.where(text, self.restart[signs], state))
        return ended


def learn_languages(
    docs: DataFrame,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = 200,
    sample_chars: int = 40_000,
    max_languages: int = 500,
) -> LanguageModel:
    """A sample of at most ``sample_docs`` documents and ``sample_chars`` characters for each language.

    Which documents is settled by a hash of their ids alone; only their ids are
    ranked, so no text moves but that of the sample. A text gives at most
    ``10 * sample_chars / sample_docs`` (2,000) folded characters. Of several rows with one id and
    language, the first text in order speaks, so the bounds hold for rows. Rows without language, id
    or text give nothing. A language whose sample has no letter is not learned, nor
    are languages beyond the ``max_languages`` with the most rows (ties by name).
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(id_col).cast("long").alias("doc_id"),
        # no more of one text than the sample can hold: this bounds what is collected
        F.substring(F.col(text_col).cast("string"), 1, sample_chars).alias("text"),
    )
    learned = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        named.select("lang", "doc_id")
        .join(F.broadcast(learned), "lang")
        .distinct()
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= sample_docs)
        .select("lang", "doc_id")
    )
    # bounded by max_languages and sample_docs, so it may be broadcast, and a row for each is collected
    picked = (
        named.where("text is not null")
        .join(F.broadcast(chosen), ["lang", "doc_id"])
        .groupBy("lang", "doc_id")
        .agg(F.min("text").alias("text"))
    )
    rows = sorted((r["lang"], r["doc_id"], r["text"]) for r in picked.toLocalIterator())
    share = max(sample_chars // max(sample_docs // 10, 1), 1)  # of one document, so that no long one is all
    samples: dict[str, str] = {}
    for lang, _, text in rows:
        if len(samples.get(lang, "")) < sample_chars:
            part = "".join(map(chr, fold(text)[:share].tolist())).replace("￿", " ")
            samples[lang] = samples.get(lang, "") + part + " "
    return LanguageModel(tuple((k, v[:sample_chars]) for k, v in sorted(samples.items()) if v.strip()))


def identify_language(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """A row per document: the predicted language, a score from 0 to 1 and the bits a character.

    A text without a letter, a null or empty text is ``und`` with score 0, and so
    is every text if no language was learned. Whole texts are parsed. The
    score is the winner's share of ``2 ** (-sharpness * bits)``. Languages that tie
    are settled by name. Rows that repeat an id are predicted each; other columns
    are not read; an empty table gives no rows. With ``carry`` the struct ``record``
    holds the document's columns.
    """
    own = id_text(docs, id_col, text_col, carry)
    kept = ["doc_id", *(["record"] if carry else [])]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model.parser() if model.samples else None
        for batch in batches:
            texts = [fold(t.as_py()) for t in batch.column("text")]
            letters = np.array([np.count_nonzero(t != 32) for t in texts], dtype=np.int64)
            names: list[str] = [UNDECIDED] * len(texts)
            score, bits = np.zeros(len(texts)), np.full(len(texts), np.nan)
            known = np.flatnonzero(letters) if parser else np.zeros(0, int)
            if len(known):
                own = [texts[i] for i in known]
                size = np.array([len(t) for t in own])
                cost = parser.phrases(own) * parser.bits / size[:, None]
                best = cost.argmin(axis=1)
                bits[known] = cost.min(axis=1)
                score[known] = 1 / np.exp2(_SHARPNESS * (cost.min(axis=1, keepdims=True) - cost)).sum(axis=1)
                for i, k in zip(known, best):
                    names[i] = parser.languages[k]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(names, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(letters, pa.int64()),
                    pa.array(bits, pa.float64(), mask=np.isnan(bits)),
                ],
                names=[*kept, "lang_pred", "score", "n_letters", "bits"],
            )

    schema = own.select(*kept).schema.add("lang_pred", StringType()).add("score", DoubleType())
    return own.mapInArrow(predict, schema.add("n_letters", LongType()).add("bits", DoubleType()))
