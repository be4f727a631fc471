import corpus_pipeline
from riskfabric.llm import language_id

from .test_models import WORDS, language_rows


def test_text_of_unknown_letters_is_rejected():
    m = language_id.Model({k: " ".join(v) for k, v in WORDS.items()})
    texts = ["это не тот язык", "lo mira тот", "lo тот язык", "vela ЖЗ", "12 漢字", "", " ".join(WORDS["aa"])]
    assert m.predict(texts)[0] == ["und", "aa", "und", "aa", "und", "und", "aa"]
    assert language_id.Model({"aa": "12 34", "bb": ""}).predict(["lo mira"]) == (["und"], [0.0])


def test_language_stage_decides_and_needs_a_learned_language(shipped):
    rows = [(i, t, k) for i, t, k in language_rows(40)] + [(100, "это не тот язык", None), (101, "lo mira", None), (102, "12", None)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.languages(shipped, docs, "").collect()}
    assert kept == {*range(40), 101}
    bare = shipped.createDataFrame([(1, None, "aa"), (2, "", "bb"), (3, "12", "aa"), (4, "some text", None), (5, "7", None)], docs.schema)
    assert [r["doc_id"] for r in corpus_pipeline.languages(shipped, bare, "").collect()] == [4]


def test_the_query_names_the_best_language_wherever_there_is_a_letter(shipped):
    rows = language_rows(40)
    model = language_id.train(shipped.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["это не тот язык", "漢字", "lo mira тот", "12 34", "", None, "vela"]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(7)] == [False, False, False, True, True, True, False]
    assert all(got[i]["lang_pred"] in ("aa", "bb") and 0 <= got[i]["score"] <= 1 for i in (0, 1, 2, 6))
    assert [got[i]["unknown_letters"] for i in (0, 1, 6)] == [1.0, 1.0, 0.0] and 0 < got[2]["unknown_letters"] < 0.5
