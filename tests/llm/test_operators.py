"""Each operator on awkward rows and on an empty table, against plain restatements."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsmetrics.llm import decontaminate, exact_dedup, langid, licenses, ngram_join, packing, pii, pu_quality, rlz_dedup, suffix_dedup
from opsmetrics.llm.queries import tokenizer_file
from tests.llm import brute
from tests.llm.conftest import PASSAGE, ROWS


def order(rows):
    return sorted(rows, key=repr)


# 1
def test_language(spark, edge, nothing):
    words = {"en": "the and of with this thing are", "fr": "le la les des est dans avec", "de": "der die und nicht mit ist ein"}
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        lang = ["en", "fr", "de"][i % 3]
        rows.append((i, " ".join(rng.choice(words[lang].split(), 60)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn_languages(docs.where("doc_id < 45"))
    out = {r["doc_id"]: r for r in langid.identify_language(docs, model).collect()}
    assert all(out[i]["lang_pred"] == lang and 0 <= out[i]["score"] <= 1 for i, _, lang in rows)

    got = langid.identify_language(edge, model, carry=True)
    assert got.select("record.*").columns == edge.columns and got.count() == len(ROWS)
    blank = {r["record"]["text"] for r in got.collect() if r["lang_pred"] == langid.UNDECIDED}
    assert blank == {None, "", " \t\n", "12345 !!! ... 67890"}
    assert langid.identify_language(nothing, model).count() == 0
    untaught = langid.learn_languages(docs.where("false"))
    assert {r["lang_pred"] for r in langid.identify_language(edge, untaught).collect()} == {langid.UNDECIDED}


def test_cross_parse_counts_longest_matches():
    sample, text = "abracadabra abba", "abrabbacada"
    parser = langid.CrossParser((("x", sample),))
    phrases, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        phrases, at = phrases + 1, at + size
    assert parser.phrases([langid.fold(text)])[0, 0] == phrases


# 2 and 9
def test_repeated_bytes(spark, edge, nothing):
    got = suffix_dedup.remove_repeated_bytes(edge).collect()
    assert order((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == order(
        brute.repeated_bytes(ROWS)
    )
    assert suffix_dedup.remove_repeated_bytes(nothing).count() == 0


def test_repeated_bytes_at_every_offset(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcd"), 400))
    rows = [(i, "".join(rng.choice(list("abcdefgh"), 7 * i % 23)) + base[i * 11 : i * 11 + 49 + i % 9]) for i in range(24)]
    rows += [(100 + i, base[i : i + 120] + "x" + base[i + 60 : i + 130]) for i in range(0, 60, 7)]
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.repeated_bytes(rows)
    assert order((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == order(want)
    assert sum(w[2] for w in want) > 500


def test_repeated_words(edge, nothing):
    got = rlz_dedup.remove_repeats(edge).collect()
    want = brute.repeated_words(ROWS)
    assert order((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == order(want)
    assert any(w[0] == 2 and w[2] == 70 for w in want)
    assert rlz_dedup.remove_repeats(nothing).count() == 0


def test_anchor_is_the_last_smallest():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 4, 300).astype(np.uint64) << np.uint64(40)
    want = [i + max(k for k in range(43) if grams[i + k] == grams[i : i + 43].min()) for i in range(300 - 42)]
    assert rlz_dedup.anchors_of(grams, 43).tolist() == want


# 3
def test_leaks(spark, edge, nothing):
    item = "That and onesen erblest it hein ti inenan eranenes whan whou therouou thon the than heoron eratsh"
    changed = item.upper().replace("HEIN", "HEIM").replace(" TI ", ", ti; ")
    rows = [(1, f"before {item} after"), (2, f"x {changed} y"), (3, item[: len(item) // 2]), (4, "unrelated words only"), (5, None), (6, "")]
    bench = spark.createDataFrame([(70, item), (71, None), (72, ""), (None, "other benchmark text of its own"), (73, "ab c")], "item_id long, text string")
    blocks = decontaminate.passage_blocks(bench, block_chars=50)
    assert len(blocks) > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontaminate.find_leaks(docs, blocks).collect()}
    assert got == {1: (True, [70]), 2: (True, [70]), 3: (False, []), 4: (False, []), 5: (False, []), 6: (False, [])}
    assert not any(r["contaminated"] for r in decontaminate.find_leaks(edge, blocks).collect())
    assert decontaminate.find_leaks(edge, blocks, carry=True).select("record.*").columns == edge.columns
    assert decontaminate.find_leaks(nothing, blocks).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.find_leaks(docs, []).collect())


def edit_distance_inside(passage, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_banded_matches_equal_full_alignment(seed):
    rng = np.random.default_rng(seed)
    passage = rng.integers(97, 117, 90).astype(np.uint32)
    edited = passage.tolist()
    for _ in range(int(rng.integers(0, 7))):
        at = int(rng.integers(0, len(edited)))
        kind = int(rng.integers(0, 3))
        edited[at : at + (kind < 2)] = [] if kind == 0 else [int(rng.integers(97, 117))]
    text = np.concatenate([rng.integers(97, 117, 200), edited, rng.integers(97, 117, 150)]).astype(np.uint32)
    index = decontaminate.Passages((1,), (passage,), 8, 0.05).index()
    distance = edit_distance_inside(passage.tolist(), text.tolist())
    found = index.matches(text)
    assert bool(found) == (distance <= 4)
    if found:
        assert min(e for _, _, e in found) == distance


# 4
def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def mod97(iban):
    moved = iban.replace(" ", "")
    moved = moved[4:] + moved[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def test_pseudonyms(spark, edge, nothing):
    cases = [
        "4111 1111 1111 1111",
        "4111111111111111",
        "DE89 3704 0044 0532 0130 00",
        "123-45-6789",
        "2024-02-29",
        "25/12/2023",
        "10.0.0.1",
        "+1 (132) 555-1352",
        "+44 20 7946 0958",
        "(212) 555-1234",
        "jo.do@mail.example.com",
        'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"',
        "4952935900253052",
    ]
    rows = [(i, f"left {c} right") for i, c in enumerate(cases)] + [(50 + i, f"again: {c}, twice {c}.") for i, c in enumerate(cases)]
    plain = ["300.1.1.1", "31/02/2020", "000-12-3456", "5", "version 2.0", "1999", "12345678"]
    rows += [(200 + i, f"kept {p} kept") for i, p in enumerate(plain)]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = [got[i]["text"][5:-6] for i in range(len(cases))]
    for i, (old, fresh) in enumerate(zip(cases, new)):
        assert fresh != old and got[50 + i]["text"] == f"again: {fresh}, twice {fresh}.", (old, fresh)
        assert sum(got[50 + i][f"n_{k}"] for k in pii.KINDS) == 2
    shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
    assert all(shape(a) == shape(b) for a, b in zip(cases[:10], new) if "." not in a and "DE" not in a)
    assert luhn(new[1]) and new[0].replace(" ", "") == new[1] and mod97(new[2]) == 1
    assert all(int(p) <= 255 for p in new[6].split("."))
    assert all(got[200 + i]["text"] == f"kept {p} kept" for i, p in enumerate(plain))
    other = pii.pseudonymise(spark.createDataFrame(rows[:2], "doc_id long, text string"), "another key").first()["text"]
    assert other != got[0]["text"]

    same = {(r["doc_id"], r["text"]) for r in pii.pseudonymise(edge, "k").collect()}
    assert same == set(ROWS)
    assert pii.pseudonymise(nothing, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(27 * 41).select(F.floor(F.col("id") / 41).alias("a"), F.pmod("id", F.lit(41)).alias("b"))
    moved = pii.feistel(F.col("a"), F.col("b"), F.lit(27).cast("long"), F.lit(41).cast("long"), F.lit("key"), "t")
    got = pairs.select(moved.alias("m")).select("m.*").distinct().collect()
    assert len(got) == 27 * 41 and all(0 <= r["a"] < 27 and 0 <= r["b"] < 41 for r in got)


# 5
def test_licenses(spark, edge, nothing):
    rows = [(i, f"Some words before.\n{text}\nand others after it") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(90, None), (91, ""), (92, "no licence here at all"), (93, " ".join(["filler"] * 500) + " " + licenses.TEMPLATES[0][1])]
    got = defaultdict(set)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].add((r["license"], r["containment"]))
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert (name, 1.0) in got[i]
    assert got[93] == {("MIT", 1.0)} and not any(got[i] for i in (90, 91, 92))
    assert licenses.scan_licenses(edge).count() == 0
    assert licenses.scan_licenses(nothing).count() == 0
    assert licenses.scan_licenses(edge, templates=()).count() == 0
    assert licenses.bands_for(0.24, 0.9999) == 34


# 6
def test_exact_classes(edge, nothing):
    keys = [(t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))) for _, t in ROWS]
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        groups[k].append(i)
    got = exact_dedup.exact_classes(edge, first_width=3, growth=2).collect()
    want = []
    for key, own in groups.items():
        stays = min(own, key=lambda i: (-len(ROWS[i][1] or ""), ROWS[i][0] is None, ROWS[i][0] or 0))
        for i in own:
            want.append((ROWS[i][0], ROWS[stays][0], len(own), brute.sha(key.encode())))
    assert order((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == order(want)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_classes(nothing).count() == 0


# 7
def test_quality(spark, edge, nothing):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}ord" for i in range(200)]
    rows, marks = [], []
    for i in range(240):
        words = list(rng.choice(vocabulary, 80))
        good = i % 4 != 0
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        if i % 3 == 0:
            marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (1, None)], "doc_id long, quality int")
    model = pu_quality.learn_quality(docs, labels)
    assert 0.5 < model.prior < 0.95
    scores = {r["doc_id"]: r["score"] for r in pu_quality.score_quality(docs, model).collect()}
    assert all((scores[i] >= 0.3) == (i % 4 != 0) for i in range(240))
    out = pu_quality.score_quality(edge, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert pu_quality.score_quality(nothing, model).count() == 0
    assert pu_quality.learn_quality(docs, labels.where("false")) is None
    assert {r["score"] for r in pu_quality.score_quality(edge, None).collect()} == {0.5}


def test_risk_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(0)
    zp, zu, weights, bias, prior = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3)), rng.normal(size=3), 0.1, 0.1

    def risk(w):
        fp, fu = zp @ w + bias, zu @ w + bias
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        assert negative > 0
        return prior * np.logaddexp(0, -fp).mean() + negative

    grad, _ = pu_quality._risk_step(zp, zu, weights, bias, prior, 0.0)
    step = np.eye(3) * 1e-6
    assert np.allclose(grad, [(risk(weights + s) - risk(weights - s)) / 2e-6 for s in step], atol=1e-5)


# 8
def near_case(seed, n=60):
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(1 << 30)}"
        rows.append((i + 1, " ".join(words)))
    rows += [(900 + i, " ".join(f"u{i}x{k}" for k in range(100))) for i in range(10)]
    return rows + [(800, rows[0][1]), (801, rows[0][1].replace(" ", "  "))]


@pytest.mark.parametrize("block_texts", [512, 7])
def test_near_duplicates(spark, block_texts):
    rows = near_case(4)
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), block_texts=block_texts).collect()
    texts = list(dict.fromkeys(" ".join(brute.WORD.findall(t)) for _, t in rows))
    pairs = brute.near_pairs(texts)
    links = Counter(i for pair in pairs for i in pair)
    root = brute.classes(len(texts), pairs)
    place = {t: i for i, t in enumerate(texts)}
    own = defaultdict(list)
    for doc_id, t in rows:
        own[root[place[" ".join(brute.WORD.findall(t))]]].append(doc_id)
    by_id = {r["doc_id"]: r for r in got}
    for members in own.values():
        for doc_id in members:
            r = by_id[doc_id]
            assert (r["class_id"], r["class_size"], r["kept"]) == (min(members), len(members), doc_id == min(members))
    for doc_id, t in rows:
        assert by_id[doc_id]["n_links"] == links[place[" ".join(brute.WORD.findall(t))]]


def test_near_duplicates_of_awkward_rows(edge, nothing):
    got = ngram_join.similar_classes(edge).collect()
    assert len(got) == len(ROWS)
    texts = [t for _, t in ROWS]
    root = brute.classes(len(ROWS), brute.near_pairs(texts) | {(i, j) for i in range(len(ROWS)) for j in range(i) if texts[i] and texts[i].strip() and texts[i] == texts[j]})
    assert sum(r["kept"] for r in got) == len(set(root))
    assert ngram_join.similar_classes(nothing).count() == 0


def test_band_choice_meets_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.choose_bands(threshold, 0.999, 128)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= 0.999


# 10
def check_packing(rows, out, capacity):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_file())
    want = []
    for doc_id, text in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids), capacity), len(ids)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert order((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == order(want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(w[3] for w in want)


def test_packing(edge, nothing):
    for capacity in (2048, 16):
        out = packing.pack_documents(edge, tokenizer_file(), capacity).collect()
        used, tokens = check_packing(ROWS, out, capacity)
        assert used <= tokens / capacity * 1.02 + 2
    assert packing.pack_documents(nothing, tokenizer_file()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plans(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(6 - seed / 2, 1, 4000).astype(int), 1, 2048)
    histogram = Counter(sizes.tolist())
    lines, used = packing.plan_packing(histogram, 2048)
    room = np.zeros((used, 2048), dtype=bool)
    ranks = defaultdict(set)
    for size, rank, count, first, offset in lines:
        for k in range(count):
            assert not room[first + k, offset : offset + size].any()
            room[first + k, offset : offset + size] = True
            assert rank + k not in ranks[size]
            ranks[size].add(rank + k)
    assert {s: len(r) for s, r in ranks.items()} == dict(histogram) and all(max(r) == len(r) - 1 for r in ranks.values())
    assert used <= sizes.sum() / 2048 * 1.02 + 2


@pytest.mark.parametrize("text", ["", " a", "a  b", "a \n b\n\nc", "tab\tx", "\x00 a b", " x y", "it's <|endoftext|> 12 34", "\x1f\x1fa", "été ñ 漢字 😀"])
def test_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    for added in (True, False):
        coder = packing.TokenIds(tokenizer_file(), added)
        whole.encode_special_tokens = not added  # off by default
        assert coder.ranked is not None
        assert coder.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_passage_is_long_enough():
    assert len(PASSAGE.split()) > 50
