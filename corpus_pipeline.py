"""From raw documents to packed token sequences, by the operators of ``opsmetrics.llm``.

Each stage takes the documents its predecessor kept, written as Parquet and read
again, and returns documents with the same columns; the last returns pieces. A
stage drops the scratch tables of the stages before it, whose results are
written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsmetrics.llm import decontaminate, exact_dedup, langid, ngram_join, packing
from opsmetrics.llm.common import Shared, read_table
from opsmetrics.llm.queries import tokenizer_file

_scratch: list[Shared] = []


def _begin(spark: SparkSession, name: str) -> Shared:
    for earlier in [s for s in _scratch if s.spark is spark]:
        earlier.close()
        _scratch.remove(earlier)
    _scratch.append(Shared(spark, name))
    return _scratch[-1]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter (null and empty texts too) go."""
    model = langid.learn_languages(docs)
    return langid.identify_language(docs, model, carry=True).where(f"lang_pred <> '{langid.UNDECIDED}'").select("record.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, blanks aside."""
    return exact_dedup.drop_copies(docs, _begin(spark, "stage_exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.keep_one(docs, _begin(spark, "stage_near"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    _begin(spark, "stage_clean")
    blocks = decontaminate.passage_blocks(read_table(spark, sf_dir, "benchmark"))
    return decontaminate.find_leaks(docs, blocks, carry=True).where("not contaminated").select("record.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_file(), shared=_begin(spark, "stage_pack"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("decontamination", clean),
    ("packing", pack),
]

#: SQL can state neither the parse by suffix automata nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read again."""
    results = Shared(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = results.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
