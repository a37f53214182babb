"""Decontamination of items with much in common, against alignments of every passage."""

import tracemalloc

import numpy as np

from opsmetrics.llm import decontaminate

LETTERS = list("abcdefghijklmnopqrstuvwxyz")


def fewest_edits(passage: np.ndarray, text: np.ndarray) -> int:
    """Fewest edits between the passage and any part of the text."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for k, sign in enumerate(passage, 1):
        fresh = np.minimum(row + 1, np.concatenate(([k], row[:-1] + (text != sign))))
        row = np.minimum.accumulate(fresh - steps) + steps
    return int(row.min())


def test_items_with_common_phrases(spark):
    rng = np.random.default_rng(8)
    known = ["".join(rng.choice(LETTERS[:9], rng.integers(2, 8))) for _ in range(50)]
    words = lambda n: " ".join(rng.choice(known, n))
    items = [("which of the following is true about " if i % 2 else "") + words(int(rng.integers(4, 40))) for i in range(40)]
    items += [items[3], items[5]]  # equal items are both named
    texts = []
    for _ in range(30):
        item = items[rng.integers(len(items))]
        copy = list(item)
        for _ in range(rng.integers(0, 8)):
            at = rng.integers(len(copy))
            copy[at : at + 1] = [[], ["q", copy[at]], ["z"]][rng.integers(3)]
        texts.append(f"{words(20)} {''.join(copy)} {words(9)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = decontaminate.passage_blocks(bench)
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_leaks(docs, blocks).collect()}
    want = {}
    for i, text in enumerate(texts):
        folded = decontaminate.fold(text)
        want[i] = sorted(
            {
                block.items[nth]
                for block in blocks
                for nth, own in enumerate(block.codes)
                if fewest_edits(own, folded) <= max(min(int(len(own) * 0.05), (len(own) - 8) // 8), 0)
            }
        )
    assert got == want
    assert 0 < sum(map(bool, want.values())) < len(want) and any({3, 40} <= set(w) or {5, 41} <= set(w) for w in want.values())


def test_a_phrase_of_all_items_takes_no_memory(monkeypatch):
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(rng.choice(LETTERS, 6)) for _ in range(n))
    phrase = "which of the following statements is a"
    items = [f"{phrase} {words(38)}" for _ in range(2000)]
    parts = [(i, p) for i, t in enumerate(items) for p in decontaminate.cut_passages(decontaminate.fold(t), 400, 64)]
    index = decontaminate.Passages(tuple(i for i, _ in parts), tuple(p for _, p in parts), 8, 0.05).index()
    text = decontaminate.fold(" ".join(f"{phrase} {words(85)}" for _ in range(80)) + " " + items[7])
    monkeypatch.setattr(decontaminate, "_HITS", 64)  # in many slices
    tracemalloc.start()
    found = index.matches(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {parts[own][0] for p, _, _ in found for own in index.owners[p]} == {7}
    assert peak < 50_000_000
