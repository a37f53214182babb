"""Manifest, filter audit and mixing against plain restatements."""

import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations
from math import exp

import pytest
from pyspark.sql import functions as F

from opsmetrics.llm import filter_audit, manifest, mixing, queries
from opsmetrics.llm.common import Shared
from opsmetrics.llm.ordering import number_within, place_in_key
from tests.llm.brute import WORD
from tests.llm.conftest import ROWS


# 11
def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def prove(leaves, fanout):
    """Root, and for each leaf its steps (left siblings, right siblings)."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, node in enumerate(at):
            first = node // fanout * fanout
            steps[i].append(("".join(level[first:node]), "".join(level[node + 1 : first + fanout])))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [node // fanout for node in at]
    return level[0], steps


def plain_manifest(rows, fanout, tamper):
    """(id, leaf, claimed leaf, subroot, root, proof) of (id, group, text) rows."""
    groups = defaultdict(list)
    for i, group, text in rows:
        groups[group].append((i, h(field(i), field(group), field(text)), h(field(i), field(group), field(tamper(i, text)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    proved = [prove([r[1] for r in groups[g]], fanout) for g in names]
    root, upper = prove([p[0] for p in proved], fanout)
    return [
        (*row, subroot, root, tuple(below) + tuple(above))
        for g, (subroot, steps), above in zip(names, proved, upper)
        for row, below in zip(groups[g], steps)
    ]


def manifest_rows():
    rows = [(i, "many" if i % 3 else f"g{i % 21}", f"text {i}\nline") for i in range(230)]
    rows += [(1000 + i, None, None) for i in range(7)] + [(5, "many", "again"), (5, "many", "again"), (None, "many", ""), (None, None, None)]
    return rows + [(2000 + i, "é" * (i % 4) + "z", "x" * 100_000) for i in range(5)]


@pytest.mark.parametrize("fanout, height", [(3, 0), (3, 2), (2, 3), (5, 6)])
def test_manifest(spark, fanout, height):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    held = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = manifest.build_manifest(docs, fanout=fanout, height=height, claimed={"text": held})
    got = got.withColumn("folded", manifest.fold(F.col("claimed_leaf"), F.col("proof"))).withColumn("digest", manifest.proof_digest(F.col("proof")))
    out = got.collect()
    want = plain_manifest(rows, fanout, lambda i, t: t.replace("\n", "") if t and i is not None and i % 2 == 0 else t)
    key = lambda r: repr(r[:5])
    assert sorted(((r["id"], r["leaf"], r["claimed_leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in out), key=key) == sorted(want, key=key)
    for r in out:
        assert (r["folded"] == r["root"]) == (r["leaf"] == r["claimed_leaf"])
        assert r["digest"] == h(*(s["left"] + s["right"] for s in r["proof"]))
    assert any(r["folded"] != r["root"] for r in out)


def test_manifest_of_awkward_rows(spark, edge, nothing):
    values = ["doc_id", "record", "text"]
    out = manifest.build_manifest(edge, values, group_col="digest", height=1).collect()
    want = Counter(h(field(i), field("r"), field(t)) for i, t in ROWS)
    assert Counter(r["leaf"] for r in out) == want and len({r["root"] for r in out}) == 1
    assert manifest.build_manifest(nothing, values, group_col="digest").count() == 0
    one = manifest.build_manifest(edge.limit(1), values, group_col="digest").first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []


def test_places_in_a_key(spark):
    shared = Shared(spark, "places")
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.lit(1).alias("same"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        rows, spans = number_within(df, ["k"], [F.col("same")], shared)
    finally:
        spark.conf.set(merging, "true")
    out = defaultdict(list)
    for r in rows.join(spans, ["part", "k"]).select("k", place_in_key().alias("place"), "total").collect():
        out[r["k"]].append(r["place"])
        assert r["total"] >= len(out[r["k"]])
    assert all(sorted(p) == list(range(len(p))) for p in out.values()) and len(out["hot"]) == 2000
    assert spans.where("k = 'hot'").count() > 1
    shared.close()


# 12
def plain_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    marked = []
    for i, text, part in docs:
        t = text or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": t in first and (i is None or first[t] < i),
        }
        marked.append((part or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        own, total = [m for m in marked if m[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(m[1][f] for m in own) - len(gone),
                    sum(m[1][f] and sum(m[1].values()) == 1 for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone),
                ]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def test_audit(spark, edge, nothing):
    base = " ".join(f"w{i}" for i in range(120))
    docs = [(i, t, ["en", None, ""][i % 3] if i else "fr") for i, (_, t) in enumerate(ROWS)]
    docs += [(100 + i, base + extra, "en") for i, extra in enumerate(["", "", " #", " " + "AB" * 60, " w1" * 99, " $ w1" * 99])]
    docs += [(None, base, "de"), (7, base, "de"), (7, base, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 106, 2)] + [(100, 0, 1), (100, 1, None), (None, 1, 1), (101, 1, 1), (3, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("fails", F.lit(9)).withColumn("good", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit_documents(frame, marks).collect()}
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit_documents(frame.where("false"), marks).count() == 0
    assert filter_audit.audit_documents(frame, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_paths_through_the_lattice():
    reach, leave = filter_audit.path_counts(4)
    for order_state in range(16):
        n = bin(order_state).count("1")
        assert reach[order_state] == [1, 1, 2, 6, 24][n] and leave[order_state] == [1, 1, 2, 6, 24][4 - n]


# 13
def plain_targets(words, weights, limit):
    """Targets by source name: shares by weight, the excess dealt out again until none is above its limit."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(words.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in names}
    held = set()
    while True:
        above = [s for s in names if s not in held and target[s] >= limit * words[s]]
        if not above:
            return target
        excess = sum(target[s] - limit * words[s] for s in above)
        held.update(above)
        for s in above:
            target[s] = limit * words[s]
        rest = sum(weight[s] for s in names if s not in held)
        for s in names:
            if s not in held and rest:
                target[s] += excess * weight[s] / rest


def mix_case():
    rows = [(i, "w " * (1 + i * i % 83), f"s{i % 7}" if i % 3 else "s0") for i in range(900)]
    rows += [(2000 + i, "x\ty " * 40, None) for i in range(30)] + [(3000, "only one " * 500, "tiny"), (3001, None, "void"), (3002, "", "void")]
    return rows + [(4000 + i % 2, "same size", "\U0001f600") for i in range(9)] + [(None, "a b c", "￮"), (5000, "l " * 30_000, "s1")]


def test_mix(spark, edge, nothing):
    rows = mix_case()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs.repartition(5), [5, 2, 1]).collect()
    words = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        words[s] += len(WORD.findall(t or ""))
    target = plain_targets(words, [5, 2, 1], 3)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in out) == Counter((i, len(WORD.findall(t or "")), s) for i, t, s in rows)
    taken, smallest = Counter(), {}
    for r in out:
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        if r["size"]:
            smallest[r["source"]] = min(r["size"], smallest.get(r["source"], r["size"]))
    for s, least in smallest.items():
        assert abs(taken[s] - target[s]) <= least, s
    again = mixing.mix_sources(docs.repartition(3), [5, 2, 1]).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix_sources(edge, [1], source_col="digest").count() == len(ROWS)
    assert mixing.mix_sources(nothing, [1], source_col="digest").count() == 0


def test_tilts_solve_the_dual(spark):
    shared = Shared(spark, "tilts")
    cases = {"a": ([3, 8, 50, 400, 400], 0.02), "b": ([1, 2, 3, 90], 0.7), "c": ([5, 6, 7, 1000], 2.9), "d": ([4, 4], 1.0), "e": ([2, 70], 3.0)}
    classes = [(k, s, n) for k, (sizes, _) in cases.items() for s, n in Counter(sizes).items()]
    sources = [(k, sum(sizes), len(sizes), min(sizes), ratio * sum(sizes)) for k, (sizes, ratio) in cases.items()]
    solved = mixing.solve_tilts(
        spark.createDataFrame(classes, "key string, size long, docs long"),
        spark.createDataFrame(sources, "key string, words long, docs long, smallest long, target double"),
        3,
        shared,
    ).collect()
    for r in solved:
        sizes, ratio = cases[r["key"]]
        mean = sum(sizes) / len(sizes)
        if ratio == 3:
            assert r["tilt"] is None
        else:
            assert sum(s * min(3, exp(min(50, r["tilt"] * s / mean))) for s in sizes) == pytest.approx(ratio * sum(sizes), rel=1e-6)
    shared.close()


def test_targets_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op13_source_mixing(spark, sf).collect()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words, taken, target = Counter(), Counter(), {}
    for r in out:
        words[sources[r["doc_id"]]] += r["size"]
        taken[sources[r["doc_id"]]] += r["taken"]
        target[sources[r["doc_id"]]] = r["target"]
    want = plain_targets(words, [5, 2, 1], 3)
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want), (taken, want)
