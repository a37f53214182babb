import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))

#: (doc_id, text): nulls, empty and very long texts, ties, repeated rows and ids, copies, passages.
ROWS = [
    (1, "The and attion to thanedble the, anea. Eriner thanea. " + PASSAGE + " tail one"),
    (2, "something else first " + PASSAGE + " and other words at the end"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "one"),
    (7, "one"),
    (7, "one"),
    (8, LONG),
    (9, LONG + " more"),
    (9, "another text under the same id as the long one"),
    (None, PASSAGE),
    (None, None),
    (10, "The The The " * 40),
    (11, "The The The " * 60),
    (12, "été ñandú ß 漢字     x" * 20),
    (13, "été ñandú ß 漢字     x" * 20),
    (-5, "one two three four five six seven eight"),
    (14, "one two  three four\nfive six seven eight"),
    (15, "12345 !!! ... 67890"),
]
CLASHING = "row long, record string, text_hash long, digest string, score double, label long, id long, kept boolean"


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above with extra columns named like those that operators make."""
    extra = (7, "r", 7, "d", 0.5, 7, 7, None)
    return spark.createDataFrame([(*r, *extra) for r in ROWS], f"doc_id long, text string, {CLASHING}")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
