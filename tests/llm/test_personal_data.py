"""Personal data: the contract's patterns as written, and the graph against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from riskfabric.llm import personal_data as D

from .conftest import make


def plain_base(text):
    """The contract's patterns in so many words."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_base_spans_are_the_contracts():
    r = random.Random(2)
    parts = list("a.b@c-d%_+ 0123456789()é\n") + ["@", ".", "1.2.3.4", "255", "256", "+1", "a@b.c", "4111 1111 1111 1111", "@@", ".."]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 30)))
        assert D.base_spans(text) == plain_base(text), text
    assert D.base_spans("4111-1111-1111-1111 x") == [(2, 0, 19)]
    assert D.base_spans("+1 (555) 010-9999.") == [(3, 0, 17)]


def test_long_runs_take_time_in_proportion():
    for run in ("z" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "1." * 1_000_000, "a@" * 500_000, "+1" * 500_000, "é" * 2_000_000):
        D.candidates(run, D.base_spans(run))


def test_candidates_avoid_base_spans_and_each_other():
    text = "bob@localhost 10.0.0.1 2001:db8::1 jane [at] site [dot] org 4111 1111 1111 1111 or 555-0100-77 or 378282246310005 or 1.2.3.4@example.org"
    base = D.base_spans(text)
    found = {(D.KINDS[k], text[s:e]) for k, s, e in D.candidates(text, base)}
    assert {("email", "bob@localhost"), ("ip", "2001:db8::1"), ("email", "jane [at] site [dot] org"), ("phone", "555-0100-77"),
            ("card", "378282246310005")} <= found
    assert not any("4111" in t or "10.0.0.1" in t or "1.2.3.4" in t for _, t in found)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(150)]

    def say(n):
        return " ".join(r.choice(words) for _ in range(n))
    rows = []
    for k in range(60):  # seeds in a telling context
        rows.append((len(rows), f"{say(8)} please call me at +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} today {say(5)}"))
        rows.append((len(rows), f"{say(5)}. My server address is {r.randrange(1, 255)}.0.{r.randrange(255)}.7 behind {say(4)}"))
    hidden = {}
    for k in range(12):  # the same context, other shapes
        hidden[len(rows)] = ("phone", f"555-01{k:02d}-77")
        rows.append((len(rows), f"{say(6)} please call me at 555-01{k:02d}-77 today {say(3)}"))
    hidden[len(rows)] = ("ip", "2001:db8::17")
    rows.append((len(rows), f"{say(3)}. My server address is 2001:db8::17 behind {say(4)}"))
    rows.append((len(rows), "a second place of it: 2001:db8::17"))
    hidden[rows[-1][0]] = ("ip", "2001:db8::17")
    clean = []
    for k in range(60):  # the same shapes where nothing tells of persons
        clean.append(len(rows))
        rows.append((len(rows), f"{say(7)} order number 770-{r.randrange(100, 999)}-{r.randrange(100, 999)} of {say(6)}"))
        rows.append((len(rows), say(30)))
    return rows, hidden, clean


def plain(rows):
    """Bases, graph and scores with dictionaries; candidates are the operator's."""
    texts = [(d, t or "") for d, t in rows]
    bases = [plain_base(t) for _, t in texts]
    found = [D.candidates(t, b) for (_, t), b in zip(texts, bases)]
    places, beside, n_edge = Counter(), defaultdict(set), Counter()
    for _, t in texts:
        own = D.tokens(t)
        for side, n in D.TEMPLATES:
            places.update((side, tuple(own[i:i + n])) for i in range(len(own) - n + 1))
    for (_, t), base, other in zip(texts, bases, found):
        for k, s, e in base + other:
            who = (k, D.instance(k, t[s:e]))
            before, behind = D.tokens(t[:s]), D.tokens(t[e:])
            for side, n in D.TEMPLATES:
                part = tuple(before[-n:] if side == "before" else behind[:n])
                if len(part) == n:
                    beside[k, side, part].add(who)
                    n_edge[(k, side, part), who] += 1
    accepted = {(k, D.instance(k, t[s:e])): 1.0 for (_, t), base in zip(texts, bases) for k, s, e in base}
    while True:
        good = {}
        for p, who in beside.items():
            mine = [w for w in who if w in accepted]
            weight = sum(n_edge[p, w] * accepted[w] for w in mine)
            if len(mine) >= D.MIN_INSTANCES and (c := weight / (max(places[p[1:]], weight) + D.PRIOR)) >= D.MIN_CONFIDENCE:
                good[p] = c
        none = defaultdict(float)
        for p, c in good.items():
            for w in beside[p]:
                if w not in accepted:
                    none[w] += math.log1p(-c)
        more = {w: 1 - math.exp(x) for w, x in none.items() if 1 - math.exp(x) >= D.MIN_SCORE}
        if not more:
            break
        accepted |= more
    out = []
    for (d, t), base, other in zip(texts, bases, found):
        added = [x for x in other if (x[0], D.instance(x[0], t[x[1]:x[2]])) in accepted]
        said = ",".join(f"{D.KINDS[k]}:{s}:{e}" for k, s, e in base)
        every = ",".join(f"{D.KINDS[k]}:{s}:{e}" for k, s, e in sorted(base + added))
        out.append((d, *[sum(k == x for k, *_ in base) for x in range(4)], hashlib.sha256(said.encode()).hexdigest(), every, len(added)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(x) for x in df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
                   .collect()), key=repr)


def test_context_finds_unseen_identifiers_and_leaves_others(shipped, corpus):
    rows, hidden, clean = corpus
    got = result(D.personal_data(make(shipped, rows).repartition(6)))
    assert got == plain(rows)
    by_doc, texts = {r[0]: r for r in got}, dict(rows)
    for d, (kind, what) in hidden.items():
        spans = [x.split(":") for x in by_doc[d][6].split(",")]
        assert any(k == kind and texts[d][int(s):int(e)] == what for k, s, e in spans), (d, spans)
    assert all(by_doc[d][6] == "" for d in clean)


def test_equals_the_plain_version_on_edge_rows(edge_docs, edge_rows):
    assert result(D.personal_data(edge_docs)) == plain(edge_rows)


def test_without_rows(no_docs):
    assert D.personal_data(no_docs).collect() == []


def test_whole_table(shipped):
    import pyarrow.parquet as pq
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = [(x["doc_id"], x["text"]) for x in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    assert result(D.query(shipped, "/root/testdata/sf0.001")) == plain(rows)


def test_the_bitmap_holds_its_codes(shipped):
    import numpy as np
    codes = [0, 1, -1, 123456789123456789, -5 << 40, (1 << D.BITMAP_BITS) - 1, 32767, 32768]
    bits = np.frombuffer(D._bitmap(shipped.createDataFrame([(c,) for c in codes], "code long")), np.uint8)
    at = {c & ((1 << D.BITMAP_BITS) - 1) for c in codes}
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == at
