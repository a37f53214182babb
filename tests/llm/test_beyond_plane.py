"""Language identification of symbols beyond the basic plane."""

from opsmetrics.llm import langid


# 1
def test_symbols_beyond_the_basic_plane_are_no_letters(spark):
    model = langid.LanguageModel((("de", "der die und nicht mit ist ein "), ("en", "the and of with this thing ")))
    rows = [(1, "😀🎉🚀 👍🏽"), (2, "\U0001f600"), (3, "the thing 😀 with"), (4, "the thing with"), (5, "\U00010400\U0001d400"), (6, "￿")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify_language(docs, model).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == langid.UNDECIDED} == {1, 2, 6}
    assert (got[1]["score"], got[1]["n_letters"]) == (0, 0) and got[5]["n_letters"] == 2
    assert got[3]["bits"] == got[4]["bits"] and got[3]["lang_pred"] == "en"
