"""The pipeline against plain restatements of its stages, and the registered queries."""

import corpus_pipeline
import __spark_entry__ as E
from opsmetrics.llm import queries
from opsmetrics.llm.common import Shared
from tests.conftest import SF_SMALL
from tests.llm import brute


def test_every_operator_is_registered():
    names = [n for n in E.queries() if n[2:].split("_")[0].isdigit() and n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert E.queries()["pipeline"] is corpus_pipeline.run and set(queries.ORACLE_SQL) <= set(E.oracle_sql())


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    results = Shared(spark, "test_pipeline")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = dict(kept)
        docs = results.table(stage(spark, docs, SF_SMALL))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            want = {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            groups = {}
            for d, t in before.items():
                key = "".join(brute.WORD.findall(t or ""))
                groups.setdefault(key, []).append((-len(t), d))
            want = {min(g)[1] for g in groups.values()}
        elif name == "ngram_join":
            ids = sorted(before)
            want = {ids[c] for c in brute.classes(len(ids), brute.near_pairs([before[i] for i in ids]))}
        else:
            want = {d for d, t in before.items() if not any(b in t for b in bench)}
        assert set(kept) == want, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept)
    results.close()


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("false")
    results = Shared(spark, "test_empty")
    for _, stage in corpus_pipeline.STAGES:
        docs = results.table(stage(spark, docs, SF_SMALL))
        assert docs.count() == 0
    results.close()
