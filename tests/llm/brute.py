"""Plain restatements of the contracts, for small tables."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_words(docs, length=50):
    """{row number: (n_words, n_removed, kept text)} for (doc_id, text) rows."""
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (doc_id, _), w in zip(docs, words):
        if doc_id is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        if doc_id is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i : i + length])] < doc_id:
                    gone.update(range(i, i + length))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeated_bytes(docs, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) for (doc_id, text) rows."""
    raw = [(t or "").encode() for _, t in docs]
    first = {}
    for (doc_id, _), b in zip(docs, raw):
        if doc_id is not None:
            for i in range(len(b) - length + 1):
                key = b[i : i + length]
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), b in zip(docs, raw):
        gone = bytearray(len(b))
        if doc_id is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < doc_id:
                    gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, n=5):
    w = WORD.findall(text or "")
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1)))


def near_pairs(texts, threshold=0.8, n=5):
    """Index pairs at the threshold; only pairs that share a shingle are compared."""
    sets = [shingles(t, n) for t in texts]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    seen = {p for own in where.values() for p in combinations(own, 2)}
    return {(a, b) for a, b in seen if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def classes(n, pairs):
    """Smallest member of each one's connected component."""
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
