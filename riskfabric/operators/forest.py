"""Boosted forests as node tables, and what is computed from them.

A model is a table of nodes (target, tree, node, feature, threshold,
default_left, left, right, value, cover).  Nodes are numbered level by level
(children of ``i`` are ``2 i + 1`` and ``2 i + 2``); leaves have no feature.
A row goes left where ``x <= threshold``, and by ``default_left`` where x is
missing.  A target's score is the logistic of the sum of its leaf values.

The table is bounded by the model's settings (outcomes x trees x nodes), so it
is broadcast once.  Tasks turn it into bit tables: for each tree, feature and
value range, the leaves that stay reachable.  A row's leaf in a tree is the
lowest bit of the AND over the features, so no task walks nodes row by row.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "target string, tree int, node int, feature string, threshold double, default_left boolean, " \
         "left int, right int, value double, cover double"
#: Leaves of a tree are bits of one machine word (of half a word where no tree has more than 32).
MAX_DEPTH = 6
#: Rows that are scored at once (an Arrow batch of the default size is one chunk).
CHUNK_ROWS = 1 << 14
#: Joint bins of a group of features at most (a code fits two bytes; tables of so many stay in the processor's cache).
JOINT_BINS = 1 << 11


class Forest:
    """The arrays of a node table: ``feature`` (-1: leaf or no node), ``threshold``, ``default_left``,
    ``value`` and ``cover``, each (target, tree, node), trees in the order of their numbers."""

    def __init__(self, features: list[str], targets: list[str], trees: int, depth: int):
        if depth > MAX_DEPTH:
            raise ValueError(f"trees are deeper than {MAX_DEPTH}")
        self.key = uuid.uuid4().hex
        self.features, self.targets, self.depth = list(features), list(targets), depth
        shape = (len(targets), trees, 2 ** (depth + 1) - 1)
        self.feature, self.there = np.full(shape, -1, np.int16), np.zeros(shape, bool)
        self.threshold, self.value, self.cover = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.default_left = np.zeros(shape, bool)

    @property
    def n_trees(self) -> int:
        return self.feature.shape[1]

    @staticmethod
    def of_rows(rows, features: list[str], targets: list[str]) -> Forest:
        """From rows of the node table; nodes must be numbered level by level."""
        rows = list(rows)
        if not rows:
            raise ValueError("the node table is empty")
        number = {t: {k: i for i, k in enumerate(sorted({r["tree"] for r in rows if r["target"] == t}))} for t in targets}
        depth = (max(r["node"] for r in rows) + 1).bit_length() - 1
        out = Forest(features, targets, max(map(len, number.values())), depth)
        for r in rows:
            at = targets.index(r["target"]), number[r["target"]][r["tree"]], r["node"]
            out.there[at], out.value[at], out.cover[at] = True, r["value"], r["cover"]
            if r["feature"] is not None:
                if (r["left"], r["right"]) != (2 * r["node"] + 1, 2 * r["node"] + 2):
                    raise ValueError("nodes aren't numbered level by level")
                out.feature[at], out.threshold[at] = features.index(r["feature"]), r["threshold"]
                out.default_left[at] = r["default_left"]
        return out

    def rows(self) -> list[tuple]:
        out = []
        for t, k, i in zip(*(x.tolist() for x in np.nonzero(self.there))):
            at = t, k, i
            f = int(self.feature[at])
            split = f >= 0
            out.append((self.targets[t], k, i, self.features[f] if split else None, float(self.threshold[at]) if split else None,
                        bool(self.default_left[at]) if split else None, 2 * i + 1 if split else None, 2 * i + 2 if split else None,
                        float(self.value[at]), float(self.cover[at])))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)


def joint_features(width, most: int = JOINT_BINS) -> list[list[int]]:
    """Features in groups whose joint bins are ``most`` at most (a feature of more is a group by itself).  A row's bins
    of a group are one code, so it is counted and looked up once a group."""
    groups: list[list[int]] = []
    for j in sorted(range(len(width)), key=lambda j: (-int(width[j]), j)):
        for g in groups:
            if math.prod(int(width[i]) for i in g) * int(width[j]) <= most:
                g.append(j)
                break
        else:
            groups.append([j])
    return groups


def lowest(bits: np.ndarray) -> np.ndarray:
    """The number of each word's lowest bit; the words are overwritten."""
    low = np.bitwise_and(bits, np.negative(bits), out=bits)
    if low.dtype == np.uint32:  # a power of two's exponent
        return (low.astype(np.float32).view(np.int32) >> 23) - 127
    return (low.astype(np.float64).view(np.int64) >> 52) - 1023


class Compiled:
    """The bit tables of a forest.  Bin b of a feature holds the values over threshold b - 1 and up
    to threshold b; the bin behind the last one holds missing values.  The tables are those of
    groups of features, by the joint code of their bins."""

    def __init__(self, f: Forest):
        self.forest, d = f, f.depth
        split = f.feature >= 0
        self.cuts = [np.unique(f.threshold[split & (f.feature == j)]) for j in range(len(f.features))]
        self.n_bins = [len(c) + 2 for c in self.cuts]
        self.offset = np.concatenate([[0], np.cumsum(self.n_bins)]).astype(np.int64)
        shape = f.feature.shape[:2]
        leaves = 1 << d
        # a tree's leaves are numbered from left to right: so many are to the left of each place of a whole level d
        nodes = np.arange(f.feature.shape[2])
        level = np.array([int(i + 1).bit_length() - 1 for i in nodes])
        width = leaves >> level
        first = (nodes + 1 - (1 << level)) * width
        ends = f.there & (f.feature < 0)
        before = np.zeros((*shape, leaves + 1), np.int64)
        for i in nodes.tolist():
            before[:, :, first[i] + 1:] += ends[:, :, i, None]
        kind = np.uint32 if before.max() <= 32 else np.uint64
        every = kind(np.iinfo(kind).max)
        masks = np.full((*shape, int(self.offset[-1])), every, kind)
        self.leaf_value, used = np.zeros((*shape, min(leaves, 32 if kind is np.uint32 else 64))), np.zeros((*shape, len(f.features)), bool)
        for t, k, i in zip(*(x.tolist() for x in np.nonzero(f.there))):
            low, middle = before[t, k, first[i]], before[t, k, first[i] + width[i] // 2]
            j = f.feature[t, k, i]
            if j < 0:
                self.leaf_value[t, k, low] = f.value[t, k, i]
                continue
            used[t, k, j] = True
            gone = kind(((1 << int(middle - low)) - 1) << int(low)) ^ every  # the leaves to the left go
            at, end = int(self.offset[j]), int(self.offset[j + 1])
            b = int(np.searchsorted(self.cuts[j], f.threshold[t, k, i]))
            masks[t, k, at + b + 1:end - 1] &= gone
            if not f.default_left[t, k, i]:
                masks[t, k, end - 1] &= gone
        self.groups, self.splits, self.shares = joint_features(self.n_bins), used, {}
        self.used, self.masks = np.stack([used[:, :, g].any(axis=2) for g in self.groups], axis=2), []
        for group in self.groups:
            joint = np.full((*shape, 1), every, kind)
            for j in group:
                own = masks[:, :, self.offset[j]:self.offset[j + 1]]
                joint = np.bitwise_and(joint[:, :, :, None], own[:, :, None, :]).reshape(*shape, -1)
            self.masks.append(joint)

    def places(self, x: np.ndarray) -> list[np.ndarray]:
        """Per feature, each row's place in the bit tables; ``x`` is (rows, features)."""
        out = []
        for j, cuts in enumerate(self.cuts):
            v = x[:, j]
            out.append(self.offset[j] + np.where(np.isnan(v), len(cuts) + 1, np.searchsorted(cuts, v, side="left")))
        return out

    def joint(self, places: list[np.ndarray], group: list[int]) -> np.ndarray:
        """Each row's place in a group's bit tables."""
        code = np.zeros(len(places[0]), np.int64)
        for j in group:
            code = code * self.n_bins[j] + (places[j] - self.offset[j])
        return code

    def leaf_sums(self, codes: list[np.ndarray], t: int, own: np.ndarray) -> None:
        """Add the leaf values of a target's trees, in their order, to ``own``."""
        for k in range(self.forest.n_trees):
            left = None
            for g in np.flatnonzero(self.used[t, k]).tolist():
                m = self.masks[g][t, k].take(codes[g])
                left = m if left is None else np.bitwise_and(left, m, out=left)
            own += self.leaf_value[t, k, 0] if left is None else self.leaf_value[t, k].take(lowest(left))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(targets, rows): sums of leaf values, in the order of the trees."""
        out = np.zeros((len(self.forest.targets), len(x)))
        for a in range(0, len(x), CHUNK_ROWS):
            places = self.places(x[a:a + CHUNK_ROWS])
            codes = [self.joint(places, g) for g in self.groups]
            for t in range(out.shape[0]):
                self.leaf_sums(codes, t, out[t, a:a + CHUNK_ROWS])
        return out

    def swapped(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(features, targets, rows): the margins of rows ``x`` with one feature at a time taken from ``z``, as
        ``margins`` has them of such rows.  What the other groups leave of a tree is looked up once a row, and
        a tree that doesn't split on the feature isn't asked again."""
        places, others = self.places(x), self.places(z)
        codes, home, moved = [self.joint(places, g) for g in self.groups], {}, {}
        for g, group in enumerate(self.groups):
            stride = 1
            for j in reversed(group):
                home[j], moved[j] = g, codes[g] + (others[j] - places[j]) * stride
                stride *= self.n_bins[j]
        out = np.zeros((len(places), len(self.forest.targets), len(x)))
        for t in range(out.shape[1]):
            for k in range(self.forest.n_trees):
                value, found = self.leaf_value[t, k], {g: self.masks[g][t, k].take(codes[g]) for g in np.flatnonzero(self.used[t, k]).tolist()}
                if not found:
                    out[:, t] += value[0]
                    continue
                rest = {g: [m for h, m in found.items() if h != g] for g in found}
                rest = {g: functools.reduce(np.bitwise_and, m) if m else None for g, m in rest.items()}
                g, first = next(iter(found.items()))
                same = value.take(lowest(first.copy() if rest[g] is None else first & rest[g]))
                for j in range(len(places)):
                    if self.splits[t, k, j]:
                        left = self.masks[home[j]][t, k].take(moved[j])
                        if rest[home[j]] is not None:
                            left &= rest[home[j]]
                        out[j, t] += value.take(lowest(left))
                    else:
                        out[j, t] += same
        return out

    def leaf_shares(self, t: int, k: int) -> list:
        """A tree's leaves for ``contributions``, made once in a worker: of each, its path's features with the
        bit that each bin gives a row's pattern, and by feature what it receives for each pattern."""
        if (t, k) not in self.shares:
            out, table = [], leaf_table(self.forest, t, k)
            if table is not None:
                players, share, allowed, value = table
                gain = coalition_gains(share) * value[:, None, None]
                for leaf in range(len(value)):
                    own = [j for j in players[leaf].tolist() if j >= 0]
                    bits = [(j, allowed(leaf, slot, self.cuts[j]).astype(np.uint8) << slot) for slot, j in enumerate(own)]
                    met = slice(gain.shape[1] - (1 << len(own)), None)  # slots without a feature always hold
                    out.append((bits, [(j, gain[leaf, met, slot].copy()) for slot, j in enumerate(own)]))
            self.shares[t, k] = out
        return self.shares[t, k]

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(targets, rows, features): Shapley values of each row's margin against the forest's mean,
        features that are out of a coalition being averaged over by the nodes' covers."""
        f = self.forest
        out = np.zeros((len(f.targets), len(f.features), len(x)))
        bins = [p - self.offset[j] for j, p in enumerate(self.places(x))]
        for t in range(len(f.targets)):
            for k in range(f.n_trees):
                for bits, gains in self.leaf_shares(t, k):
                    which = functools.reduce(np.bitwise_or, [bit.take(bins[j]) for j, bit in bits]).astype(np.intp)
                    for j, gain in gains:
                        out[t, j] += gain.take(which)
        return out.transpose(0, 2, 1)


def leaf_table(f: Forest, t: int, k: int):
    """A tree's leaves as tables: the features on each leaf's path (-1: none), the share of the
    training rows that each feature's splits let through, which bins they let through, the leaf's
    value.  None where the tree is one leaf."""
    if f.feature[t, k, 0] < 0:
        return None
    depth = f.depth
    players, share, tests, value = [], [], [], []
    stack = [(0, {})]
    while stack:
        i, path = stack.pop()
        j = int(f.feature[t, k, i])
        if j < 0:
            players.append([*path, *[-1] * (depth - len(path))])
            share.append([*(s for s, _ in path.values()), *[1.0] * (depth - len(path))])
            tests.append([c for _, c in path.values()])
            value.append(f.value[t, k, i])
            continue
        for child, left in ((2 * i + 2, False), (2 * i + 1, True)):
            s, c = path.get(j, (1.0, ()))
            part = f.cover[t, k, child] / f.cover[t, k, i] if f.cover[t, k, i] else 0.0
            stack.append((child, path | {j: (s * part, (*c, (f.threshold[t, k, i], left, bool(f.default_left[t, k, i]))))}))

    def allowed(leaf: int, slot: int, cuts: np.ndarray) -> np.ndarray:
        ok = np.ones(len(cuts) + 2, bool)
        for threshold, left, default_left in tests[leaf][slot]:
            b = int(np.searchsorted(cuts, threshold))
            goes = np.arange(len(ok)) <= b
            goes[-1] = default_left
            ok &= goes == left
        return ok
    return np.array(players), np.array(share), allowed, np.array(value)


def coalition_gains(share: np.ndarray) -> np.ndarray:
    """(leaves, outcomes, players): what each player adds to a leaf of value 1, on average over the
    orders of players.  ``share`` is (leaves, players); an outcome's bits say whose splits hold.

    A leaf's value for a coalition is the product over its members of 1 or 0 (the splits hold) and
    over the others of their share, so a player's average needs the sums over coalitions of each
    size of the other players' products: the coefficients of prod(o y + z).  Players without splits
    (1 and share 1) change nothing for the others."""
    leaves, m = share.shape
    outcome = np.arange(1 << m)
    holds = (outcome[:, None] >> np.arange(m)) & 1  # (outcomes, players)
    weight = np.empty(m)  # size! (m - size - 1)! / m!
    for size in range(m):
        w = 1.0 / m
        for i in range(size):
            w *= (i + 1) / (m - 1 - i)
        weight[size] = w
    out = np.empty((leaves, len(outcome), m))
    for p in range(m):
        sums = np.zeros((leaves, len(outcome), m))
        sums[:, :, 0] = 1.0
        for q in range(m):
            if q != p:
                more = sums * share[:, q, None, None]
                more[:, :, 1:] += sums[:, :, :-1] * holds[None, :, q, None]
                sums = more
        out[:, :, p] = (holds[None, :, p] - share[:, p, None]) * (sums @ weight)
    return out


_COMPILED: dict[str, Compiled] = {}


def compiled(f: Forest) -> Compiled:
    """The bit tables, made once in a worker; an earlier forest's go."""
    if f.key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[f.key] = Compiled(f)
    return _COMPILED[f.key]


def _inputs(batch: pa.RecordBatch, n: int) -> np.ndarray:
    cols = [batch.column(batch.num_columns - n + j).to_numpy(zero_copy_only=False) for j in range(n)]
    return np.stack(cols, axis=1).astype(np.float64) if batch.num_rows else np.empty((0, n))


def _with_inputs(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise KeyError(f"rows have no {', '.join(missing)}")
    return df.select(*keep, *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)])


def score(forest: Forest, df: DataFrame, keep: list[str], margins: bool = False) -> DataFrame:
    """Columns ``keep`` + ``pred_<target>`` (M3): the probability of class 1 of every row for every
    outcome, all from one pass and one broadcast.  Missing features follow the splits' defaults.
    ``margins`` adds ``margin_<target>``, the sums of leaf values."""
    given = _with_inputs(df, keep, forest.features)
    kept = given.select(*given.columns[:len(keep)])
    names = [f"pred_{t}" for t in forest.targets] + ([f"margin_{t}" for t in forest.targets] if margins else [])
    schema = T.StructType(kept.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])
    shared, n = df.sparkSession.sparkContext.broadcast(forest), len(forest.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compiled(shared.value)
        for b in batches:
            sums = work.margins(_inputs(b, n))
            cols = [1.0 / (1.0 + np.exp(-sums)), sums] if margins else [1.0 / (1.0 + np.exp(-sums))]
            yield pa.RecordBatch.from_arrays([*b.columns[:b.num_columns - n], *[pa.array(r) for c in cols for r in c]],
                                             names=[f.name for f in schema])
    return given.mapInArrow(run, schema)


def swapped_right(forest: Forest, pairs: DataFrame, targets: list[str], threshold: float) -> DataFrame:
    """``_feature`` and per target ``_c_<target>``, a row per feature and task: how many rows of ``pairs`` are on the
    right side of ``threshold`` once the feature is taken from ``_d_<feature>``.  Missing outcomes are never right."""
    features, at = forest.features, [forest.targets.index(t) for t in targets]
    given = pairs.select(*[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate([
        *targets, *features, *[f"_d_{f}" for f in features]])])
    shared, n = pairs.sparkSession.sparkContext.broadcast(forest), len(features)
    names = ["_feature", *[f"_c_{t}" for t in targets]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, some, right = compiled(shared.value), False, np.zeros((n, len(targets)), np.int64)
        for b in batches:
            x = _inputs(b, b.num_columns)
            for a in range(0, len(x), CHUNK_ROWS):
                y, own, donor = np.split(x[a:a + CHUNK_ROWS], [len(targets), len(targets) + n], axis=1)
                sure = 1.0 / (1.0 + np.exp(-work.swapped(own, donor)[:, at])) > threshold
                right += (sure == y.T[None]).sum(axis=2)
            some |= len(x) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(features), *[pa.array(c) for c in right.T.copy()]], names=names)
    return given.mapInArrow(run, ", ".join(["_feature string", *[f"`{c}` long" for c in names[1:]]]))


def shapley(forest: Forest, df: DataFrame, id_col: str = "resp_id") -> DataFrame:
    """``<id>, feature, target, phi`` (M6): exact Shapley values of every row's margin.  A row's
    values sum to its margin minus the forest's mean margin over the training rows' paths.

    Every leaf only concerns the features on its path, so a row takes each leaf's share from a table
    by the pattern of path features that it meets; nothing is scored again per coalition."""
    given = _with_inputs(df, [id_col], forest.features)
    shared, n, features, targets = df.sparkSession.sparkContext.broadcast(forest), len(forest.features), forest.features, forest.targets
    kind = given.schema[0].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("target", T.StringType()),
                           *[T.StructField(f"_phi{j}", T.DoubleType()) for j in range(n)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compiled(shared.value)
        for b in batches:
            if b.num_rows:
                for t, phi in zip(targets, work.contributions(_inputs(b, n))):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t] * b.num_rows), *[pa.array(c) for c in phi.T]],
                                                     names=[f.name for f in schema])
    wide = given.mapInArrow(run, schema)
    items = [F.struct(F.lit(c).alias("feature"), F.col(f"_phi{j}").alias("phi")) for j, c in enumerate(features)]
    return wide.select(id_col, "target", F.inline(F.array(*items))).select(id_col, "feature", "target", "phi")


def save(forest: Forest, spark: SparkSession, path: str) -> str:
    """The node table as Parquet."""
    forest.table(spark).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, path: str, features: list[str], targets: list[str]) -> Forest:
    """A saved node table; its rows are bounded by the model's settings."""
    return Forest.of_rows((r.asDict() for r in spark.read.schema(SCHEMA).parquet(path).collect()), features, targets)
