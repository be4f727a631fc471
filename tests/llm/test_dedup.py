import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from riskfabric.llm import exact_dedup, line_dedup, ngram_join
from riskfabric.llm.components import connected_components

from .conftest import make

WHITE = re.compile("[\x20\x09-\x0d]")


def test_exact_dedup_on_edges(edge_docs, edge_rows):
    groups = defaultdict(list)
    for d, t in edge_rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), d is None, d or 0))
    got = exact_dedup.exact_dedup(edge_docs).collect()
    assert len(got) == len(edge_rows)
    kept = defaultdict(int)
    for r in got:
        text = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}[r["text_sha256"]]
        best = min(groups[text])
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == (None if best[1] else best[2])
        kept[text] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}  # of rows repeated with one id, too, exactly one stays


@pytest.mark.parametrize("heavy,tracked", [(1, 4), (512, 4096)])
def test_heavy_hitters_change_nothing(shipped, heavy, tracked):
    rows = [(i, f"copy  {i % 3}") for i in range(60)] + [(100 + i, f"single {i}") for i in range(40)] + [(200, "copy 0 ")]
    got = exact_dedup.exact_dedup(make(shipped, rows), heavy=heavy, tracked=tracked).collect()
    assert sum(r["kept"] for r in got) == 43
    assert {r["keep_id"] for r in got if r["group_size"] > 1} == {0, 1, 2} and max(r["group_size"] for r in got) == 21


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def brute_lines(rows, min_chars=20, min_docs=3):
    rows = [(d, t) for d, t in rows if d is not None]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_on_edges(edge_docs, edge_rows):
    got = [tuple(r) for r in line_dedup.line_dedup(edge_docs).collect()]
    assert sorted(g for g in got if g[0] is not None) == brute_lines(edge_rows)
    (alone,) = [g for g in got if g[0] is None]
    assert alone[2] == 0


def test_a_line_over_many_partitions(shipped):
    line = "a line that nearly all documents hold, twice"
    rows = [(i, f"{line}\nown words of {i} and nothing else\n{line}" if i % 5 else f"short {i}") for i in range(400)]
    before = shipped.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in line_dedup.line_dedup(make(shipped, rows)).collect())
    finally:
        shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == brute_lines(rows) and sum(g[2] for g in got) == 2 * 319


def test_bitmaps_apply_to_texts_and_keep_columns(shipped, edge_docs, edge_rows):
    maps = line_dedup.line_bitmaps(edge_docs)
    out = line_dedup.apply_bitmaps(edge_docs, maps)
    assert out.columns == edge_docs.columns and out.count() == len(edge_rows)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] is None and texts[11] == "first\nlast" and texts[12] == "body of twelve" and texts[13] == "" and texts[14].count("\n") == 1
    m = {r["doc_id"]: r for r in maps.collect()}
    assert line_dedup.read_bitmap(bytes(m[11]["keep_bitmap"]), 3).tolist() == [True, False, True]


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup.line_dedup(no_docs).count() == 0


def brute_components(rows):
    sets = defaultdict(set)
    for d, t in rows:
        if d is not None:
            w = (t or "").encode().lower().split()
            n = min(5, len(w))
            sets[d] |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ngram_join_on_edges(edge_docs, edge_rows):
    got = ngram_join.near_duplicate_components(edge_docs).collect()
    assert len(got) == len(edge_rows)
    want = brute_components(edge_rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_shingles"] == 0 and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert len({c for _, c in want.values()}) < len(want) - 6


def test_ngram_join_of_large_groups_in_small_blocks(shipped, monkeypatch):
    """Chains of near copies, wider than a link reaches, over many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    r = np.random.default_rng(4)
    rows, base = [], [f"w{i}" for i in range(80)]
    for k in range(90):
        w = list(base)
        for i in r.choice(80, r.integers(0, 4), replace=False):
            w[i] = f"x{r.integers(0, 10 ** 6)}"
        rows.append((k, " ".join(w)))
    cur = [f"c{i}" for i in range(60)]
    for k in range(40):
        cur = list(cur)
        cur[r.integers(0, 60)] = f"d{k}"
        rows.append((200 + k, " ".join(cur)))
    rows += [(300 + k, " ".join(f"s{k}w{i}" for i in range(30))) for k in range(30)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicate_components(make(shipped, rows)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_of_nothing(no_docs):
    assert ngram_join.near_duplicate_components(no_docs).count() == 0


def test_components_of_chains_stars_and_no_edges(shipped):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    got = {r["id"]: r["component"] for r in connected_components(shipped.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 560)} == {500} and got[9] == got[8] == 8
    assert connected_components(shipped.createDataFrame([], "a long, b long")).count() == 0
