import random

from riskfabric.llm import decontaminate

from .conftest import make


def items_of(n=60, seed=11):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(3, 8))) for _ in range(3_000)]
    return [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(8, 40))) + "? " + " ".join(r.choice(vocab) for _ in range(r.randrange(5, 9))))
            for i in range(n)]


def found(items, texts):
    index = decontaminate.Index([(i, *decontaminate.question_and_answer(t)) for i, t in items])
    return [set(index.leaks(t.encode(), decontaminate.TwoGenerations(1000))) for t in texts]


def test_an_inserted_and_a_changed_word_hide_no_item(shipped):
    items = items_of()
    inserted, changed = [], []
    for _, t in items:
        q, a = t.split("? ")
        inserted.append(f"words before {q}? Answer: {a} and after")
        w = t.split()
        w[len(w) // 2 - 2] = "changed"
        changed.append(" ".join(w))
    assert found(items, inserted) == found(items, changed) == [{i} for i, _ in items]
    rows = [(100 + i, t) for i, t in enumerate(inserted)] + [(300, items[0][1].split("?")[0])]
    got = decontaminate.contaminated(make(shipped, rows), shipped.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(100 + i, i) for i, _ in items]
    assert all(r["question_overlap"] == r["answer_overlap"] == 1.0 and r["shingle_overlap"] < 1.0 for r in got)
    assert min(r["shingle_overlap"] for r in got) < 0.8  # reported, decides nothing


def test_every_unicode_space_cuts_items_and_documents(monkeypatch):
    items = items_of()
    for space in ["\xa0", "\u202f", "\u2009", "\u3000", "\u2028", "\x85", "\x1f", "\xa0 \u3000"]:
        assert found(items, [space.join(t.split()) for _, t in items]) == [{i} for i, _ in items]
        assert found([(i, space.join(t.split())) for i, t in items], [t for _, t in items]) == [{i} for i, _ in items]
    one = [f"before {' '.join(w[:k])}\u202f{' '.join(w[k:])} after" for _, t in items for w in [t.split()] for k in [len(w) // 2]]
    assert found(items, one) == [{i} for i, _ in items]
    # over the borders of a text's pieces, also between words that are only marks
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 200)
    monkeypatch.setattr(decontaminate, "chunks", lambda t, cut=decontaminate.chunks: cut(t, 200))
    assert found(items, [f"{'filler ' * 25}{t} \xa0 {t}".replace(" ", " - -- \xa0") for _, t in items]) == [{i} for i, _ in items]


UNSPACED = [(1, "什么河流过旧磨坊？它叫银色的小溪。"),
            (2, "最初に溶けた金属は何ですか。それはスズです。"),
            (3, "แม่น้ำชื่ออะไร ลำธารเงิน")]


def test_items_in_scripts_without_spaces(shipped):
    q, a = decontaminate.question_and_answer(UNSPACED[0][1])
    assert "".join(q) + "?" + "".join(a) == UNSPACED[0][1].replace("？", "?").rstrip("。")
    assert all(q + a == decontaminate.words_of(t) for _, t in UNSPACED for q, a in [decontaminate.question_and_answer(t)])
    alone = [t for _, t in UNSPACED]
    inside = [f"我们在读{t}然后走了 แล้ว{t}จบ" for t in alone]  # letters at both edges
    marked = [f"「{t[:9]}、{t[9:]}」" for t in alone]
    question = [UNSPACED[0][1].split("？")[0], "这是一段无关的文字。"]
    assert found(UNSPACED, alone) == found(UNSPACED, inside) == found(UNSPACED, marked) == [{1}, {2}, {3}]
    assert found(UNSPACED, question) == [set(), set()]
    docs = make(shipped, list(enumerate(inside + question)))
    got = decontaminate.contaminated(docs, shipped.createDataFrame(UNSPACED, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 1), (1, 2), (2, 3)]


def test_scores_are_the_same_over_one_index_and_several(shipped, monkeypatch):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(12)]  # few words: pairs that many items have
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, f"{say(r.randrange(4, 20))} own{i} it{i}? {say(4)}") for i in range(60)] + [(7, None), (61, "word")]
    docs = [(i, f"filler {' '.join(w[:len(w) // 2])} changed {' '.join(w[len(w) // 2:])} filler") for i, t in items if t for w in [t.split()]]
    df, benchmark = make(shipped, docs), shipped.createDataFrame(items, "item_id long, text string").repartition(3)
    rows = lambda: sorted(tuple(x) for x in decontaminate.contaminated(df, benchmark).collect())
    whole = rows()
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 9)
    several = rows()
    assert len(whole) >= 55 and [x[:2] for x in several] == [x[:2] for x in whole]
    assert all(abs(a - b) < 1e-9 for x, y in zip(whole, several) for a, b in zip(x[2:], y[2:]))


def test_a_long_item_beside_short_ones_changes_nothing(shipped, monkeypatch):
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(3, 8))) for _ in range(3_000)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [*items_of(20), (500, f"{say(1500)}? {say(20)}")]
    short = dict(items)[0].split()
    quarter = -(-len(short) // 4)
    pieces = [" ".join(short[k:k + quarter]) for k in range(0, len(short), quarter)]
    docs = [(1, f"{say(700)} {' '.join(short[:len(short) // 2])} inserted {' '.join(short[len(short) // 2:])} {say(700)}"),
            (2, f" {say(300)} ".join(pieces)),  # the item's words, far apart
            (3, f"{say(50)} {items[-1][1]} {say(50)}"), (4, f"{say(400)} {dict(items)[1]} {say(400)}")]
    df = make(shipped, docs)
    rows = lambda given: sorted(tuple(x) for x in decontaminate.contaminated(df, shipped.createDataFrame(given, "item_id long, text string")).collect())
    one = rows(items)
    assert [x[:2] for x in one] == [(1, 0), (3, 500), (4, 1)]
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 2)
    several = rows(items)
    assert [x[:2] for x in several] == [x[:2] for x in one]
    assert all(abs(a - b) < 1e-9 for x, y in zip(one, several) for a, b in zip(x[2:], y[2:]))


def test_items_repeated_with_one_id_are_found_by_each_text(shipped):
    items = [(1, dict(items_of())[0]), (1, dict(items_of())[1])]
    docs = make(shipped, [(10, items[0][1]), (11, items[1][1]), (12, "none of them")])
    got = decontaminate.contaminated(docs, shipped.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(10, 1), (11, 1)]
