"""Joint boosting and what is computed from a forest, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark import RDD

from riskfabric.functions import fixed
from riskfabric.operators import boosting, forest, metrics, model
from riskfabric.operators.forest import Forest

FEATURES, TARGETS = ["a", "b", "c", "d"], ["t", "u"]


def walk(f: Forest, t: int, k: int, row) -> float:
    i = 0
    while f.feature[t, k, i] >= 0:
        v = row[f.feature[t, k, i]]
        left = bool(f.default_left[t, k, i]) if v is None or math.isnan(v) else v <= f.threshold[t, k, i]
        i = 2 * i + (1 if left else 2)
    return f.value[t, k, i]


def grown(seed: int, trees: int = 4, depth: int = 3, features=FEATURES, targets=TARGETS) -> Forest:
    """Some forest with leaves at several levels and covers that add up."""
    r = random.Random(seed)
    f = Forest(features, targets, trees, depth)
    for t, k in itertools.product(range(len(targets)), range(trees)):
        f.there[t, k, 0], f.cover[t, k, 0] = True, 64
        for i in range(f.feature.shape[2]):
            if not f.there[t, k, i]:
                continue
            f.value[t, k, i] = r.randrange(-20, 20) / 8
            if 2 * i + 2 < f.feature.shape[2] and r.random() < 0.85:
                f.feature[t, k, i], f.threshold[t, k, i] = r.randrange(len(features)), r.randrange(1, 6)
                f.default_left[t, k, i] = r.random() < 0.5
                part = r.choice([0.25, 0.5, 0.75])
                for child, share in ((2 * i + 1, part), (2 * i + 2, 1 - part)):
                    f.there[t, k, child], f.cover[t, k, child] = True, f.cover[t, k, i] * share
    return f


def some_rows(n: int, seed: int = 1, width: int = 4) -> np.ndarray:
    r = random.Random(seed)
    return np.array([[r.choice([r.randrange(0, 7), r.random() * 6, math.nan]) for _ in range(width)] for _ in range(n)], float)


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_bit_tables_give_the_leaf_of_a_walk(depth):
    f = grown(3, trees=5, depth=depth)
    x = some_rows(300)
    got = forest.Compiled(f).margins(x)
    for t in range(2):
        assert np.allclose(got[t], [sum(walk(f, t, k, row) for k in range(5)) for row in x], atol=1e-12)


def coalition_value(f: Forest, t: int, k: int, row, members, i: int = 0) -> float:
    """A node's value where features outside the coalition are averaged over by cover."""
    j = int(f.feature[t, k, i])
    if j < 0:
        return f.value[t, k, i]
    below = [coalition_value(f, t, k, row, members, c) for c in (2 * i + 1, 2 * i + 2)]
    if j in members:
        v = row[j]
        left = f.default_left[t, k, i] if math.isnan(v) else v <= f.threshold[t, k, i]
        return below[0] if left else below[1]
    return sum(b * f.cover[t, k, c] for b, c in zip(below, (2 * i + 1, 2 * i + 2))) / f.cover[t, k, i]


@pytest.mark.parametrize("seed,depth", [(1, 2), (2, 3), (5, 4)])
def test_contributions_equal_enumeration(seed, depth):
    f = grown(seed, depth=depth)
    x = some_rows(25, seed)
    got = forest.Compiled(f).contributions(x)
    for t, (n, row) in itertools.product(range(2), enumerate(x)):
        value = {s: sum(coalition_value(f, t, k, row, s) for k in range(4))
                 for size in range(5) for s in map(frozenset, itertools.combinations(range(4), size))}
        for j in range(4):
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value[s | {j}] - value[s])
                       for s in value if j not in s)
            assert abs(got[t, n, j] - want) < 1e-9
        assert abs(got[t, n].sum() - (value[frozenset(range(4))] - value[frozenset()])) < 1e-9


def table(spark, n=900, seed=3, holes=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [r.randrange(0, 9), r.randrange(0, 3), r.randrange(40) / 4, r.randrange(0, 2)]
        x = [None if holes and r.random() < 0.15 else float(v) for v in x]
        t = int(r.random() < (0.8 if x[0] is None or x[0] > 5 else 0.2))
        u = int(r.random() < (0.7 if x[1] == 1 and (x[2] or 0) > 4 else 0.3))
        rows.append((i, *x, t, u))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, d double, t int, u int")


def brute_tree(x, y, base, min_rows, depth):
    """The first tree by trying every threshold and side of missing values at every node."""
    p = 1 / (1 + math.exp(-base))
    g, h = y - p, np.full(len(y), p * (1 - p))

    def grow(i, at, level, out):
        def gain(rows):
            return g[rows].sum() ** 2 / h[rows].sum()
        best = None
        if level < depth:
            for j in range(x.shape[1]):
                v = x[at, j]
                for side in (False, True):
                    for c in np.unique(v[~np.isnan(v)]):
                        left = np.where(np.isnan(v), side, v <= c)
                        if min(left.sum(), (~left).sum()) < min_rows:
                            continue
                        now = gain(at[left]) + gain(at[~left]) - gain(at)
                        if now > 1e-9 and (best is None or now > best[0] + 1e-9):
                            best = (now, j, c, side, at[left], at[~left])
        if best:
            out[i] = best[:4]
            grow(2 * i + 1, best[4], level + 1, out)
            grow(2 * i + 2, best[5], level + 1, out)
        else:
            out[i] = boosting.LEARNING_RATE * g[at].sum() / h[at].sum()
        return out
    return grow(0, np.arange(len(y)), 0, {})


def test_first_trees_equal_brute_force(spark):
    rows, df = table(spark)
    f = boosting.train_forest(df.repartition(3), FEATURES, TARGETS, rounds=1, depth=3)
    x = np.array([[math.nan if v is None else v for v in r[1:5]] for r in rows])
    for t in range(2):
        y = np.array([r[5 + t] for r in rows], float)
        base = math.log(y.mean() / (1 - y.mean()))
        want = brute_tree(x, y, base, boosting.MIN_CHILD_ROWS, 3)
        assert abs(f.value[t, 0, 0] - base) < 1e-12
        assert {i for i in range(15) if f.there[t, 1, i]} == set(want)
        for i, w in want.items():
            if not isinstance(w, tuple):
                assert f.feature[t, 1, i] == -1 and abs(f.value[t, 1, i] - w) < 1e-9
                continue
            assert f.feature[t, 1, i] == w[1]
            # the same rows go left: thresholds may differ between two neighbouring values of a node
            v = x[:, w[1]]
            mine = np.where(np.isnan(v), f.default_left[t, 1, i], v <= f.threshold[t, 1, i])
            assert 0 < mine.sum() < len(mine)
            total = lambda at: ((y - y.mean())[at].sum()) ** 2 / max(at.sum(), 1)
            if i == 0:
                other = np.where(np.isnan(v), w[3], v <= w[2])
                assert abs(total(mine) + total(~mine) - total(other) - total(~other)) < 1e-9


def test_partitions_do_not_change_the_fit(spark, monkeypatch):
    _, df = table(spark, 600)
    one = boosting.train_forest(df.coalesce(1), FEATURES, TARGETS, rounds=12, depth=3)
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100)
    monkeypatch.setattr(boosting, "DIRECT_PARTITIONS", 2)  # summed in a tree
    many = boosting.train_forest(df.repartition(6), FEATURES, TARGETS, rounds=12, depth=3)
    assert (one.feature == many.feature).all() and np.allclose(one.value, many.value, atol=1e-9)


def test_leaves_are_bounded_by_the_greatest_gains(spark):
    _, df = table(spark)
    whole = boosting.train_forest(df, FEATURES, TARGETS, rounds=1, depth=3)
    small = boosting.train_forest(df, FEATURES, TARGETS, rounds=1, depth=3, max_leaves=3)
    for t in range(2):
        assert (small.there[t, 1] & (small.feature[t, 1] < 0)).sum() == 3
        assert small.feature[t, 1, 0] == whole.feature[t, 1, 0]
        (split,) = [i for i in (1, 2) if small.feature[t, 1, i] >= 0]  # one of the two nodes of the second level
        assert small.feature[t, 1, split] == whole.feature[t, 1, split]


def test_missing_values_learn_their_side(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 7), int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, t int")
    f = boosting.train_forest(df, ["a"], ["t"], rounds=30, depth=2)
    got = forest.score(f, df.limit(9), ["id"]).toPandas().set_index("id")["pred_t"]
    assert got[0] > 0.8 and got[1] < 0.2


def test_degenerate_tables(spark):
    df = spark.createDataFrame([(1.0, 1)] * 50, "a double, t int")  # one value, one outcome
    f = boosting.train_forest(df, ["a"], ["t"], rounds=3, depth=2)
    assert forest.score(f, df.limit(1), []).first()[0] > 0.99
    with pytest.raises(ValueError):
        boosting.train_forest(df.limit(0), ["a"], ["t"], rounds=1, depth=2)
    assert forest.score(f, df.limit(0), ["t"]).collect() == []
    with pytest.raises(KeyError):
        forest.score(f, df.select("t"), ["t"])


def test_missing_place_values_are_scored_as_they_are(spark):
    f = grown(9, features=fixed.FEATURE_COLUMNS, targets=fixed.TARGET_COLUMNS, depth=3)
    x = some_rows(40, 4, len(fixed.FEATURE_COLUMNS))
    df = spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)],
                               ", ".join(["id long", *[f"{c} double" for c in fixed.FEATURE_COLUMNS]]))
    got = model.score(f, df, ["id", "bmi"]).collect()  # a kept column may be a feature
    for r in got:
        for t, name in enumerate(fixed.TARGET_COLUMNS):
            m = sum(walk(f, t, k, x[r["id"]]) for k in range(4))
            assert abs(r[f"pred_{name}"] - 1 / (1 + math.exp(-m))) < 1e-12


def test_node_table_round_trip(spark, tmp_path):
    f = grown(7)
    path = forest.save(f, spark, str(tmp_path / "nodes"))
    again = forest.load(spark, path, FEATURES, TARGETS)
    for name in ("feature", "threshold", "default_left", "value", "cover", "there"):
        assert (getattr(f, name) == getattr(again, name)).all()
    rows = [r.asDict() for r in f.table(spark).collect()]
    next(r for r in rows if r["feature"])["left"] = 5
    with pytest.raises(ValueError):
        Forest.of_rows(rows, FEATURES, TARGETS)
    with pytest.raises(ValueError):
        Forest.of_rows([], FEATURES, TARGETS)


@pytest.mark.parametrize("n", [1, 2, 6, 97, 1000, 30030])
def test_shuffles_are_permutations(n):
    for k in range(10):
        a, b = model.shuffle_terms(k, n)
        assert len({(a * j + b) % n for j in range(n)}) == n


def test_auc_on_a_planted_signal(spark):
    _, df = table(spark, 2000, seed=8)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    f = boosting.train_forest(train, FEATURES, TARGETS, rounds=40, depth=4)
    scored = forest.score(f, test, ["id", "t", "u"])
    long = scored.selectExpr("id", "stack(2, 't', t, pred_t, 'u', u, pred_u) as (target, y, p)")
    auc = {r.target: r.roc_auc for r in metrics.roc_auc(long).collect()}
    assert auc["t"] > 0.7 and auc["u"] > 0.55


def test_the_driver_receives_one_array_an_outcome(spark, monkeypatch):
    received, collect = [], RDD.collect

    def counted(rdd):
        got = collect(rdd)
        received.append(len(got))
        return got
    monkeypatch.setattr(RDD, "collect", counted)
    monkeypatch.setattr(boosting, "PARTITION_ROWS", 100)
    boosting.train_forest(table(spark, 600)[1].repartition(6), FEATURES, TARGETS, rounds=2, depth=3)
    assert received and max(received) == len(TARGETS)  # however many partitions there are


def test_rows_are_added_up_and_looked_up_by_joint_codes():
    r = np.random.default_rng(4)
    width = np.array([14, 9, 7, 255, 3, 51, 5, 3])
    groups = forest.joint_features(width)
    assert sorted(j for g in groups for j in g) == list(range(8)) and len(groups) <= 4
    assert all(math.prod(int(width[j]) for j in g) <= forest.JOINT_BINS for g in groups)
    bins = np.stack([r.integers(0, w, 700) for w in width]).astype(np.uint8)
    y, margin = r.integers(0, 2, (1, 700)).astype(np.uint8), r.normal(size=(1, 700))
    feature, cut, default_left = np.full((1, 15), -1, np.int16), np.zeros((1, 15), np.int16), np.zeros((1, 15), bool)
    for i, (j, c, left) in {0: (3, 120, True), 1: (0, 6, False), 2: (5, 49, True), 4: (3, 60, False)}.items():
        feature[0, i], cut[0, i], default_left[0, i] = j, c, left
    value = r.normal(size=(1, 15))
    trees, slots = (feature, cut, default_left, value), np.array([[-1, -1, 0, 1, -1, -1, 2, -1]])
    offset = np.concatenate([[0], np.cumsum(width)])

    def node(row, level):
        i = 0
        for _ in range(level):
            j = feature[0, i]
            if j < 0:
                break
            b = bins[j, row]
            i = 2 * i + (1 if (default_left[0, i] if b == width[j] - 1 else b <= cut[0, i]) else 2)
        return i
    codes = boosting.joint_codes(bins, groups, width)
    block = codes, y, margin
    got = dict(boosting._histograms(trees, 3, slots, offset, groups)(5, [block, block]))
    p = 1 / (1 + np.exp(-margin[0]))
    want = np.zeros((3, 3, offset[-1]))
    for row in range(700):
        i = node(row, 3)
        s = slots[0, i - 7] if i >= 7 else -1
        for j in range(8):
            if s >= 0:
                want[:, s, offset[j] + bins[j, row]] += 2 * np.array([y[0, row] - p[row], p[row] * (1 - p[row]), 1])
    assert got[0][0] == 5 and want[2].any() and np.allclose(got[0][1], want, atol=1e-9)
    (_, _, after), = boosting._update(trees, 3, groups, width)([block])
    assert np.allclose(after[0], margin[0] + [value[0, node(row, 3)] for row in range(700)])


def test_scores_take_one_table_a_group():
    f = grown(7, trees=3, depth=4)
    work = forest.Compiled(f)
    assert len(work.masks) == len(work.groups) < len(f.features)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(forest, "joint_features", lambda width: [[j] for j in range(len(width))])
        alone = forest.Compiled(f)
    x = some_rows(500, 9)
    assert len(alone.masks) == len(f.features) and (work.margins(x) == alone.margins(x)).all()


def test_the_smaller_child_is_summed(spark, monkeypatch):
    levels, summed = [], boosting._summed

    def seen(*args):
        got = summed(*args)
        levels.append(got[:, 2].sum(axis=2))  # rows by outcome and node: each is in one bin of the only feature
        return got
    monkeypatch.setattr(boosting, "_summed", seen)
    f = boosting.train_forest(spark.createDataFrame([(float(i % 5), int(i % 5 == 4 or i % 11 == 0)) for i in range(900)], "a double, t int"),
                              ["a"], ["t"], rounds=2, depth=3)
    cover = f.cover[0]
    for k, got in ((1, levels[:3]), (2, levels[3:])):
        for level, rows in enumerate(got[1:], 1):
            split = [i for i in range((1 << level >> 1) - 1, (1 << level) - 1) if f.feature[0, k, i] >= 0]
            assert rows[0].tolist() == [min(cover[k, 2 * i + 1], cover[k, 2 * i + 2]) for i in split]


def test_swapped_features_are_scored_as_rows_that_hold_them():
    f = grown(5, trees=5, depth=4)
    x, z = some_rows(300, 2), some_rows(300, 3)
    got = forest.Compiled(f).swapped(x, z)
    for j in range(len(f.features)):
        row = x.copy()
        row[:, j] = z[:, j]
        assert (got[j] == forest.Compiled(f).margins(row)).all()


def test_permutation_importance_of_a_forest_needs_no_row_per_feature(spark, monkeypatch):
    f = grown(6, trees=5, depth=4)
    x = some_rows(400, 8)
    rows = [(i, *[None if math.isnan(v) else float(v) for v in row], *[None if i % 9 == t else (i + t) % 2 for t in range(len(f.targets))])
            for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{c} double" for c in f.features], *[f"{t} int" for t in f.targets]]))
    scored, score = [], model.score

    def seen(models, rows, keep):
        scored.append(rows)
        return score(models, rows, keep)

    def importance(scorer):
        got = model.permutation_importance(df, scorer, 3, f.features, f.targets, "id").collect()
        return {(r["feature"], r["target"]): r["importance"] for r in got}
    plain = importance(lambda rows, keep: score(f, rows, keep))
    monkeypatch.setattr(model, "score", seen)
    assert importance(model.gbt_scorer(f)) == plain and len(plain) == len(f.features) * len(f.targets) and any(plain.values())
    assert len(scored) == 1  # the baseline


def test_leaves_of_a_forest_are_worked_out_once_for_shapley_values(monkeypatch):
    f, asked, gains = grown(7, trees=3, depth=4), [], forest.coalition_gains
    monkeypatch.setattr(forest, "coalition_gains", lambda share: asked.append(len(share)) or gains(share))
    work = forest.Compiled(f)
    first, again = (work.contributions(some_rows(50, seed)) for seed in (1, 1))
    assert (first == again).all() and len(asked) <= f.n_trees * len(f.targets)
