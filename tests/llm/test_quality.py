"""Quality posteriors against a plain recomputation from each document's own evidence."""

import math
import random
import zlib
from collections import defaultdict

import pytest

from riskfabric.llm import quality


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def strength(groups, parents, squares):
    """``groups``: (parent, n, s); the variance between groups beyond the one inside them."""
    n, s = sum(g[1] for g in groups), sum(g[2] for g in groups)
    within = squares - sum(g[2] ** 2 / g[1] for g in groups)
    eff = between = 0.0
    for p in parents:
        own = [g for g in groups if g[0] == p]
        pn, ps = sum(g[1] for g in own), sum(g[2] for g in own)
        eff += pn - sum(g[1] ** 2 for g in own) / pn
        between += sum(g[2] ** 2 / g[1] for g in own) - ps ** 2 / pn
    k, u = len(groups), len(parents)
    if not eff or k <= u or n <= k:
        return 1e9
    inside = max(0.0, within / (n - k))
    between = (between - (k - u) * inside) / eff
    mean = s / n
    return min(1e9, max(0.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e9


def plain(rows, p_text, label):
    """Quality of each row (doc_id, host, path) from its evidence."""
    e = [float(label[d]) if d in label and not held_out(d) else p for (d, *_), p in zip(rows, p_text)]
    path, host = defaultdict(list), defaultdict(list)
    for (_, h, q), x in zip(rows, e):
        path[h, q].append(x)
        host[h].append(x)
    squares, mean = sum(x * x for x in e), sum(e) / len(e)
    mean = min(1 - 1e-6, max(1e-6, mean))
    by_host = strength([(1, len(x), sum(x)) for x in host.values()], [1], squares)
    by_path = strength([(h, len(x), sum(x)) for (h, _), x in path.items()], list(host), squares)

    def logit(p):
        p = min(1 - 1e-6, max(1e-6, p))
        return math.log(p / (1 - p))
    out = []
    for (_, h, q), x, p in zip(rows, e, p_text):
        top = (sum(host[h]) - x + mean * (by_host + 1e-9)) / (len(host[h]) - 1 + by_host + 1e-9)
        site = (sum(path[h, q]) - x + top * (by_path + 1e-9)) / (len(path[h, q]) - 1 + by_path + 1e-9)
        out.append((1 / (1 + math.exp(-(logit(p) + logit(site) - logit(mean)))), site, top))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_equal_a_plain_recomputation(shipped, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(500):
        h = r.choice(["big"] * 6 + ["a", "b", "c", "d", f"only{i}", None])
        q = r.choice(["x", "y", None])
        good = r.random() < {"big": 0.5, "a": 0.9, "b": 0.2}.get(h, 0.5)
        words = [r.choice(["plain", "words", "here", "and", "there"]) if good else r.choice(["##", "12|", "junk*"]) for _ in range(r.randrange(0, 30))]
        text = None if i % 50 == 0 else "" if i % 50 == 1 else " ".join(words)
        rows.append((i if i % 60 else None, text, h, q))
        if i % 60 and r.random() < 0.6:
            labels.append((i, int(good)))
    rows += [(1000, "very long " * 60_000, "big", "x"), (1001, "tied label", "a", "x")] + rows[10:13]
    labels += [(1001, 0), (1001, 1), (None, 1)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    for c in ("host", "path", "label", "train", "e", "n", "s", "row", "p_text"):
        from pyspark.sql import functions as F
        docs = docs.withColumn(c, F.lit("clash"))
    got = quality.quality(docs, shipped.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    label = {d: y for d, y in labels if d is not None} | {1001: 1}
    evidence = defaultdict(list)
    for x in got:
        evidence[x["doc_id"]].append(x["p_text"])
    own = []
    for d, t, *_ in rows:  # rows of one id are copies here, but those without an id differ
        own.append(None if d is None else evidence[d][0])
    nones = sorted(x["p_text"] for x in got if x["doc_id"] is None)
    texts = [t for d, t, *_ in rows if d is None]
    known = {}
    for x in got:
        if x["doc_id"] is None:
            known.setdefault(round(x["p_text"], 12), x["p_text"])
    assert len(nones) == len(texts)
    # the classifier sees the text alone: copies with an id tell the evidence of those without
    again = quality.quality(shipped.createDataFrame([(5000 + i, t, "z", "z") for i, t in enumerate(texts)],
                                                    "doc_id long, text string, source string, lang string").unionByName(
        docs.select("doc_id", "text", "source", "lang")), shipped.createDataFrame(labels, "doc_id long, quality int")).collect()
    by = {x["doc_id"]: x["p_text"] for x in again}
    same = {x["doc_id"]: x["p_text"] for x in got if x["doc_id"] is not None}
    assert all(abs(by[d] - p) < 1e-9 for d, p in same.items())
    free = iter([by[5000 + i] for i in range(len(texts))])
    own = [next(free) if p is None else p for p in own]
    want = plain([(d, h or "", q or "") for d, _, h, q in rows], own, label)
    key = lambda x: (x[0] is None, x[0] or 0, *(round(v, 7) for v in x[1:]))
    a = sorted(((x["doc_id"], x["quality"], x["path_quality"], x["host_quality"]) for x in got), key=key)
    b = sorted(((d, *w) for (d, *_), w in zip(rows, want)), key=key)
    for x, y in zip(a, b):
        assert x[0] == y[0] and all(abs(v - w) < 1e-6 for v, w in zip(x[1:], y[1:])), (x, y)
