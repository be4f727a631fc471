import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfabric.llm import decontaminate, gru, language_id, lm_score, quality

from .conftest import make

WORDS = {"aa": ["lo", "mira", "tanto", "vela", "sol"], "bb": ["ich", "schatz", "zwerg", "pfad", "nacht"]}


def language_rows(n=120, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[k]) + r.choice(WORDS[k]) for _ in range(r.randrange(3, 40))), k)
            for i in range(n) for k in [r.choice(["aa", "bb"])]]


def test_phrases_equal_a_plain_greedy_parse():
    refs = {"a": "the cat sat on the mat and ran", "b": "le chat est sur la table et dort"}
    m = language_id.Model(refs)
    r = random.Random(2)
    for _ in range(60):
        text = "".join(r.choice("the cat sat onmdzé.9 ") for _ in range(r.randrange(0, 700)))
        count, n, _ = m.phrases([text])
        s = m.symbols([text])[0].tobytes()
        assert n[0] == len(s)
        for k, name in enumerate(m.languages):
            ref, want = m.symbols([refs[name]])[0].tobytes(), 0
            for i in range(0, len(s), language_id.SEGMENT):
                z, j = s[i:i + language_id.SEGMENT], 0
                while j < len(z):
                    e = 1
                    while j + e <= len(z) and z[j:j + e] in ref:
                        e += 1
                    j += max(1, e - 1)
                    want += 1
            assert count[0, k] == want


def test_language_of_held_out_text_and_edges(shipped, edge_docs, edge_rows):
    rows = language_rows()
    df = shipped.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id < 60"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}
    assert np.mean([got[i][0] == k for i, _, k in rows if i >= 60]) == 1.0
    assert all(0 <= s <= 1 for _, s in got.values())
    edge = language_id.identify(edge_docs, model).collect()
    assert len(edge) == len(edge_rows)
    by = {r["doc_id"]: r["lang_pred"] for r in edge}
    assert by[0] == by[1] == by[2] == by[10] == "und" and by[15] in ("aa", "bb") and by[17] in ("aa", "bb")


def test_language_column_and_no_labels(shipped, edge_docs, no_docs):
    df = shipped.createDataFrame(language_rows(30), "doc_id long, text string, lang string")
    model = language_id.train(df)
    lang = language_id.language_of(edge_docs, model)
    one = {r["doc_id"]: r["x"] for r in edge_docs.select("doc_id", lang("text").alias("x")).collect()}
    assert one == {r["doc_id"]: r["lang_pred"] for r in language_id.identify(edge_docs, model).collect()}
    none = language_id.train(df.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(edge_docs, none).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0


def test_a_long_text_is_parsed_whole(monkeypatch):
    m = language_id.Model({k: " ".join(v) for k, v in WORDS.items()})
    monkeypatch.setattr(language_id, "PART", 512)
    text = "lo mira " * 10 + "ich schatz nacht " * 300
    assert m.predict([text])[0] == ["bb"] and m.predict([text[::-1], None, ""])[0][1:] == ["und", "und"]


def tiny_gru(seed=3):
    g = gru.Gru(np.array([9, 7, 5, 4, 3, 2, 6]), np.array([0, 2, 5, 6, 7]))
    r = np.random.default_rng(seed)
    g.p = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in g.p.items()}
    return g


def test_gru_probabilities_sum_to_one_and_state_is_carried():
    g = tiny_gru()
    h = np.random.default_rng(1).normal(0, 1, (1, gru.HIDDEN))
    assert np.exp(g.log_probs(np.repeat(h, 7, 0), np.arange(7))).sum() == pytest.approx(1)
    docs = [np.array(d, np.int32) for d in ([0, 1, 2, 3, 4, 5] * 9, [], [3], [5, 5, 0])]
    got = g.score(docs, 6)
    for d, s in zip(docs, got):
        state, last, want = np.zeros((1, gru.HIDDEN)), 6, 0.0
        for y in [*d.tolist(), 6]:
            state, _ = g.step(np.array([last]), state)
            want += g.log_probs(state, np.array([y]))[0]
            last = y
        assert s == pytest.approx(want, rel=1e-5)


def test_gru_gradient_against_differences():
    x = np.array([[0, 6], [1, 2], [3, 4], [5, 0]])
    y = np.array([[1, 2], [3, 4], [5, 0], [6, 6]])
    fresh = np.zeros_like(x, bool)
    fresh[0] = True
    fresh[2, 1] = True

    def loss(g):
        h, total = np.zeros((2, gru.HIDDEN)), 0.0
        for t in range(4):
            h, _ = g.step(x[t], h * ~fresh[t][:, None])
            total -= g.log_probs(h, y[t]).sum()
        return total / 8
    for name in gru.Gru.NAMES:
        g = tiny_gru()
        before = {k: v.copy() for k, v in g.p.items()}
        memory = {k: np.full_like(v, 1e30) for k, v in g.p.items()}  # steps of 1e-15 x the gradient
        g.learn(x, y, fresh, np.zeros((2, gru.HIDDEN)), memory, 1e3 * 1e12)
        step = (before[name] - g.p[name]).ravel()
        k = int(np.abs(step).argmax())
        g.p = {n: v.copy() for n, v in before.items()}
        flat, eps = g.p[name].reshape(-1), 1e-5
        flat[k] += eps
        up = loss(g)
        flat[k] -= 2 * eps
        assert step[k] == pytest.approx((up - loss(g)) / (2 * eps), rel=1e-2)


def test_lm_score_counts_base_and_model(shipped, edge_rows):
    rows = [(i, t) for i, t, _ in language_rows(300)] + [(1000 + (d if d is not None else 500), t) for d, t in edge_rows]
    df = make(shipped, rows).repartition(3)
    train = df.where("doc_id % 4 <> 1")
    got = lm_score.score(df, lm_score.train(train)).collect()
    c, docs = Counter(), 0
    for d, t in rows:
        if d % 4 != 1:
            c.update((t or "").encode().lower().split())
            docs += 1
    n, v = c.total() + docs, len(c) + 1
    texts = Counter((d, t) for d, t in rows)
    assert len(got) == len(rows) == texts.total()
    by = {d: t for d, t in rows}
    gain = 0.0
    for r in got:
        w = (by[r["doc_id"]] or "").encode().lower().split()
        counts = [c[x] for x in w] + [docs]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(x > 0 for x in counts), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in counts))
        assert r["score"] < 0
        if r["doc_id"] < 300 and r["doc_id"] % 4 == 1:
            gain += r["score"] - r["base_score"]
    assert gain > 0  # held-out documents are likelier under the recurrent model


def test_lm_score_without_training_rows(shipped, no_docs):
    trained = lm_score.train(no_docs)
    (r,) = lm_score.score(make(shipped, [(1, "a b")]), trained).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and np.isfinite(r["score"]) and np.isfinite(r["base_score"])
    assert lm_score.score(no_docs, trained).count() == 0


def quality_rows(seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(600):
        host = r.choice(["big"] * 12 + ["bad"] * 4 + [f"h{r.randrange(60)}"])
        good = r.random() < (0.2 if host == "bad" else 0.85)
        words = [r.choice("alpha beta gamma delta on the of river".split()) for _ in range(r.randrange(5, 60))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, None if i % 50 == 0 else text, host, r.choice(["p", "q", None]), int(good)))
    return rows


def test_quality_on_held_out_labels_and_sites(shipped):
    rows = quality_rows()
    docs = shipped.createDataFrame([x[:4] for x in rows] + [rows[3][:4]], "doc_id long, text string, source string, lang string") \
        .withColumn("e", F.lit("x")).withColumn("label", F.lit("x")).withColumn("p_text", F.lit("x"))
    labels = shipped.createDataFrame([(x[0], x[4]) for x in rows[:400]] + [(None, 1), (3, rows[3][4])], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 601
    want = {x[0]: x[4] for x in rows if x[1] is not None}
    held = [(r["good"], want[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in want]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)
    assert np.mean([a == bool(b) for a, b in held]) > 0.97
    site = {x[0]: x[2] for x in rows}
    mean = lambda h: np.mean([r["host_quality"] for r in got if site[r["doc_id"]] == h])
    assert mean("bad") < 0.5 < mean("big")
    sizes = Counter(x[2] for x in rows + [rows[3]])
    single = {round(r["host_quality"], 6) for r in got if sizes[site[r["doc_id"]]] == 1}
    assert len(single) == 1  # a host without other documents has the global mean


def test_quality_without_labels_or_documents(shipped):
    docs = shipped.createDataFrame([(1, "some text", "h", "p"), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    none = shipped.createDataFrame([], "doc_id long, quality int")
    assert [round(r["quality"], 3) for r in quality.quality(docs, none).collect()] == [0.5, 0.5]
    assert quality.quality(docs.where("false"), none).count() == 0


ITEMS = [(1, "What is the name of the river that runs past the old mill? It is the Silver Brook."),
         (2, "Which metal did the smith of the northern valley melt first? He melted plain tin."), (3, "word"), (4, None)]


def test_search_equals_scoring_everything():
    r = random.Random(6)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, [r.choice(vocab) for _ in range(r.randrange(2, 40))], [r.choice(vocab)]) for i in range(120)]
    index = decontaminate.Index(items)
    for k in range(150):
        terms = sorted(r.sample(range(len(index.lists)), r.randrange(1, 80)))
        threshold = r.choice([0.02, 0.1, 0.3])
        scores = Counter()
        for t in terms:
            for d, w in zip(*index.lists[t]):
                scores[d] += w
        assert sorted(d for d, _ in index.search(terms, threshold)) == sorted(d for d, s in scores.items() if s >= threshold - 1e-9)


def test_leaks_are_found_and_clean_text_is_left(shipped, edge_docs, no_docs):
    r = random.Random(8)
    fill = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(4)) for _ in range(n))
    rows = [(1, fill(500) + "\n" + ITEMS[0][1].upper() + " " + fill(30)), (2, ITEMS[1][1].replace(" ", "  ")), (2, ITEMS[1][1].replace(" ", "  ")),
            (3, ITEMS[0][1].split("?")[0]), (4, fill(50)), (5, None), (6, ""), (7, ITEMS[0][1] + fill(3) + ITEMS[1][1]), (8, "word")]
    items = shipped.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = sorted((x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(make(shipped, rows), items).collect())
    assert got == [(1, 1), (2, 2), (2, 2), (7, 1), (7, 2)]
    assert decontaminate.contaminated(edge_docs, items).count() == 0
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(make(shipped, rows), items.where("false")).count() == 0


def test_leaks_in_a_text_of_many_pieces_and_several_indexes(shipped, monkeypatch):
    index = decontaminate.Index([(i, *decontaminate.question_and_answer(t)) for i, t in ITEMS])
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 200)
    monkeypatch.setattr(decontaminate, "chunks", lambda t: __import__("riskfabric.llm._common", fromlist=["chunks"]).chunks(t, 200))
    text = ("filler words go on and on " * 9 + ITEMS[0][1] + " filler words " * 20 + ITEMS[1][1]).encode()
    assert sorted(index.leaks(text, decontaminate.TwoGenerations(1000))) == [1, 2]
