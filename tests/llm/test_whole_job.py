"""Cases that earlier versions of the operators left out."""

import numpy as np

from opsmetrics.llm import decontaminate, pii


# 3
def test_partial_and_straddling_copies_are_leaks(spark):
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(n))
    short, long_ = words(50), words(134)  # 299 and 803 characters
    bench = spark.createDataFrame([(1, short), (2, long_)], "item_id long, text string")
    part = long_[350:460].upper()
    rows = [
        (1, f"{words(20)} {short[: len(short) // 2]} {words(20)}", [1]),
        (2, f"{words(20)} {short[len(short) // 2 :]}", [1]),
        (3, f"{words(9)} {long_[120:680]} {words(9)}", [2]),  # across every cut, no part whole
        (4, f"{words(9)} {part[:50]}#{part[51:]} {words(9)}", [2]),
        *((10 + k, long_[at : at + 95], [2]) for k, at in enumerate(range(0, 803 - 95, 59))),
        (50, f"{words(9)} {long_[300:350]} {words(9)}", []),
        (51, words(200), []),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for block_chars in (2_000_000, 700):
        blocks = decontaminate.passage_blocks(bench, block_chars=block_chars)
        got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_leaks(docs, blocks).collect()}
        assert got == {i: want for i, _, want in rows}


# 4
def pseudonyms(spark, cases):
    rows = [(i, f"left {c} right") for i, c in enumerate(cases)]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    return [(got[i]["text"][5:-6], {k for k in pii.KINDS if got[i][f"n_{k}"]}) for i in range(len(cases))]


def test_secrets_of_any_length_and_with_dots(spark):
    long_, jwt = "Ab3" * 400, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    values = [long_, jwt, "x" * 257, "abcdefgh"]
    for sign in ('token = "{}"', "api_key={}", "password: {}."):
        for value, (new, kinds) in zip(values, pseudonyms(spark, [sign.format(v) for v in values])):
            head, tail = sign.split("{}")
            assert new.startswith(head) and new.endswith(tail) and kinds == {"secret"}
            fresh = new[len(head) : len(new) - len(tail)]
            assert len(fresh) == len(value) and set(fresh) <= set("0123456789abcdef")
    assert len({new.split("=")[1].strip(' "') for new, _ in pseudonyms(spark, [f"token={jwt}", f'secret = "{jwt}"'])}) == 1


def test_national_phones_and_other_dates(spark):
    phones = ["212-555-1234", "212.555.1234", "212 555 1234", "1-212-555-1234", "1 212 555 1234", "212 555-1234"]
    phones += ["020 7946 0958", "06 12 34 56 78", "030 1234567", "0171/1234567", "(020) 7946 0958"]
    dates = ["12/25/23", "25/12/23", "31-12-99", "01.02.03", "3 March 2024", "3rd of March 2024", "March 3, 2024", "MAR 3 2024"]
    dates += ["03-Mar-24", "1 sept. 1999", "May 21st, 2001", "29 February 2024"]
    shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
    new = pseudonyms(spark, phones + dates)
    for old, (fresh, kinds) in zip(phones, new):
        assert kinds == {"phone"} and fresh != old and shape(fresh) == shape(old), (old, fresh)
    assert new[0][0].replace("-", "") == new[1][0].replace(".", "") == new[2][0].replace(" ", "")
    for old, (fresh, kinds) in zip(dates, new[len(phones) :]):
        assert kinds == {"date"} and fresh != old, (old, fresh)
        assert not any(c.isalpha() for c in old) or any(c.isalpha() for c in fresh)
    assert all(kinds == {"date"} for _, kinds in pseudonyms(spark, [f for f, _ in new[len(phones) :]]))  # they stay dates
    plain = ["31/31/31", "30 February 2024", "March 2024", "version 1.2.10", "100 200 3000", "32 March 2024", "Marching 3 2024"]
    assert pseudonyms(spark, plain) == [(p, set()) for p in plain]
