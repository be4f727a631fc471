"""Joint gradient boosting of several binary outcomes (M2).

All outcomes share the rows, so they are boosted together: one Spark job per
tree level sums the histograms (gradients, curvatures, counts) of every
outcome, open node, feature and bin, and the driver, which receives one array of
sums an outcome, chooses all splits of the level.  A tree has 31 leaves at most; where a level
could split more nodes than that leaves room for, the greatest gains are taken.  A
fit of 200 rounds is some 1,000 to 1,200 jobs, whatever the number of outcomes or nodes.

Rows are packed into blocks of binned features, small ones joined to groups of one
code, so that a row is added up once a group; a block's margins change every round, so blocks are an RDD of arrays that stays in the executors' memory (as
the bytes that go to a worker, not serialized once more) or on their disks and is checkpointed to the shared folder every few rounds.  A level
reads each block once, and of two children sums the one with fewer rows; the partitions' arrays (nodes x bins of an outcome, whatever
the number of rows) meet in one task an outcome, which adds them up in the order of
the partitions, so what the driver receives doesn't grow with rows or partitions.

Splits are second-order (logistic loss).  A missing value has a bin of its own,
and each split learns the side that it goes to; where a node has seen none, it
goes to the side with more rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_path
from ..sources.sinks import remove, write_table
from .forest import Forest, joint_features, lowest

LEARNING_RATE, MAX_LEAVES, MAX_BINS, MIN_CHILD_ROWS, MIN_CHILD_WEIGHT, MIN_GAIN = 0.1, 31, 254, 20, 1e-3, 1e-9
#: Rows of a block, and of a partition at least (fewer mean more overhead than work) and at most.
BLOCK_ROWS, PARTITION_ROWS, MAX_PARTITION_ROWS = 1 << 16, 1 << 15, 1 << 20
#: Rows that are worked on at once: what is computed on the way stays in the processor's cache.
CHUNK_ROWS = 1 << 14
CHECKPOINT_ROUNDS = 10
#: Partitions whose sums one task adds up; of more, groups of so many are added first.
DIRECT_PARTITIONS = 32


def bin_edges(train: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature the upper edges of its bins: values at equally spaced ranks, the greatest left
    out (beyond the last edge is a bin, too).  Few distinct values are all edges."""
    if max_bins > MAX_BINS:
        raise ValueError(f"a bin is one byte: {MAX_BINS} bins at most")
    at = [i / max_bins for i in range(1, max_bins)]
    got = train.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(c) for c in features],
                    *[F.max(F.col(c).cast("double")).alias(f"{c}_max") for c in features]).first()
    out = []
    for c in features:
        values = np.unique(np.array(got[c] if got[c] is not None else [], np.float64))
        out.append(values[values < got[f"{c}_max"]] if len(values) else values)
    return out


def _packed(edges: list[np.ndarray], n_targets: int):
    """Blocks: bins (features x rows) and outcomes (outcomes x rows), a byte each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block():
            x = np.concatenate(held, axis=1)
            return pa.RecordBatch.from_pydict({"n": pa.array([x.shape[1]], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})
        for b in batches:
            cols = []
            for j, e in enumerate(edges):
                v = b.column(j).to_numpy(zero_copy_only=False)
                cols.append(np.where(np.isnan(v), len(e) + 1, np.searchsorted(e, v, side="left")).astype(np.uint8))
            cols += [b.column(len(edges) + t).to_numpy(zero_copy_only=False).astype(np.uint8) for t in range(n_targets)]
            if b.num_rows:
                held.append(np.stack(cols))
                rows += b.num_rows
            if rows >= BLOCK_ROWS:
                yield block()
                held, rows = [], 0
        if rows:
            yield block()
    return run


def joint_codes(bins: np.ndarray, groups: list[list[int]], width: np.ndarray) -> np.ndarray:
    """(groups, rows): each row's joint code, the group's last feature counting fastest."""
    out = np.zeros((len(groups), bins.shape[1]), np.uint16)
    for code, group in zip(out, groups):
        for j in group:
            code *= np.uint16(width[j])
            code += bins[j]
    return out


def _reach(feature: np.ndarray, cut: np.ndarray, default_left: np.ndarray, level: int, groups: list[list[int]],
           width: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """A tree as bit tables: by group that it splits on, and joint code, the nodes of ``level`` that stay
    reachable.  Below a node without a split all do, so its first one stands for it."""
    nodes = 1 << level
    kind = np.uint32 if nodes <= 32 else np.uint64
    masks: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(feature[:nodes - 1] >= 0).tolist():
        at, j = (i + 1).bit_length() - 1, int(feature[i])
        under = nodes >> at
        stay = kind(((1 << nodes) - 1) ^ (((1 << under // 2) - 1) << (i + 1 - (1 << at)) * under))
        own = masks.setdefault(j, np.full(width[j], (1 << nodes) - 1, kind))
        own[cut[i] + 1:-1] &= stay
        if not default_left[i]:
            own[-1] &= stay
    out = []
    for k, group in enumerate(groups):
        if any(j in masks for j in group):
            table = np.full(1, (1 << nodes) - 1, kind)
            for j in group:
                table = np.bitwise_and.outer(table, masks.get(j, np.full(width[j], (1 << nodes) - 1, kind))).ravel()
            out.append((k, table))
    return out


def _places(codes: np.ndarray, tables: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Each row's node, counted from the first of its level: the lowest bit that all groups leave."""
    if not tables:
        return np.zeros(codes.shape[1], np.int64)
    left = None
    for k, table in tables:
        m = table.take(codes[k])
        left = m if left is None else np.bitwise_and(left, m, out=left)
    return lowest(left)


def _histograms(trees, level: int, slots: np.ndarray, offset: np.ndarray, groups: list[list[int]]):
    """Sums over a partition's rows: (outcome, (partition, [gradient, curvature, rows] x (slots, bins))).
    ``slots`` gives the nodes of the level that are asked for their places (-1: not asked for).  Rows are
    summed by the joint codes of the groups, and these sums give those of each feature's bins.  All outcomes
    count the same rows at the root, so they are counted once there."""
    feature, cut, default_left, _ = trees
    n_targets, width = len(feature), np.diff(offset)

    def run(partition, blocks):
        asked_for, size = slots.max(axis=1) + 1, [int(np.prod(width[g])) for g in groups]
        sums = [[np.zeros(int(k) * w, np.complex128) for w in size] for k in asked_for]  # gradient + i curvature
        rows = [[np.zeros(int(k) * w, np.int64) for w in size] for k in asked_for]
        tables = [_reach(feature[t], cut[t], default_left[t], level, groups, width) for t in range(n_targets)] if level else []
        for codes, y, margin in blocks:
            for a in range(0, codes.shape[1], CHUNK_ROWS):
                code = codes[:, a:a + CHUNK_ROWS].astype(np.intp)
                for t in range(n_targets):
                    if not asked_for[t]:
                        continue
                    m, own, asked, slot = margin[t, a:a + CHUNK_ROWS], y[t, a:a + CHUNK_ROWS], None, None
                    if level:
                        slot = slots[t].take(_places(code, tables[t]))
                        asked = np.flatnonzero(slot >= 0)
                        m, own, slot = m.take(asked), own.take(asked), slot.take(asked)
                    p = 1.0 / (1.0 + np.exp(-m))
                    both = np.empty(len(m), np.complex128)
                    both.real, both.imag = own - p, p * (1.0 - p)
                    for k, w in enumerate(size):
                        key = code[k]
                        if asked is not None:
                            key = slot * w
                            key += code[k].take(asked)
                        np.add.at(sums[t][k], key, both)
                        if level or not t:
                            np.add.at(rows[t][k], key, 1)
        if not level:
            rows = rows[:1] * n_targets
        for t, k in enumerate(asked_for):
            if k:
                parts = np.empty((3, int(k), int(offset[-1])))
                for group, one, n in zip(groups, sums[t], rows[t]):
                    joint = np.stack([one.real, one.imag, n]).reshape(3, int(k), *width[group])
                    for i, j in enumerate(group):
                        parts[:, :, offset[j]:offset[j + 1]] = joint.sum(axis=tuple(2 + q for q in range(len(group)) if q != i))
                yield t, (partition, parts)
    return run


def _update(trees, levels: int, groups: list[list[int]], width: np.ndarray):
    """Blocks with the margins that the round's trees add to."""
    feature, cut, default_left, value = trees

    def run(blocks):
        tables = [_reach(feature[t], cut[t], default_left[t], levels, groups, width) for t in range(len(feature))]
        leaf = np.zeros((len(feature), 1 << levels))
        for t in range(len(feature)):
            for i in range((2 << levels) - 1):
                if i == 0 or feature[t, (i - 1) // 2] >= 0:
                    at = (i + 1).bit_length() - 1
                    under = (1 << levels) >> at
                    first = (i + 1 - (1 << at)) * under
                    leaf[t, first:first + under] = value[t, i]
        for codes, y, margin in blocks:
            margin = margin.copy()
            for a in range(0, codes.shape[1], CHUNK_ROWS):
                code = codes[:, a:a + CHUNK_ROWS].astype(np.intp)
                for t in range(len(feature)):
                    margin[t, a:a + CHUNK_ROWS] += leaf[t].take(_places(code, tables[t]))
            yield codes, y, margin
    return run


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.divide(g * g, h, out=np.zeros_like(g), where=h > 0)


def best_splits(hist: np.ndarray, offset: np.ndarray, min_rows: int = MIN_CHILD_ROWS,
                min_weight: float = MIN_CHILD_WEIGHT) -> dict[str, np.ndarray]:
    """The best split of every (outcome, node): ``gain`` (0: none), ``feature``, ``cut`` (the last bin
    that goes left), ``default_left``, and ``left``/``right`` sums.  Of equal gains the first feature,
    then missing values to the right, then the lowest cut count."""
    total = hist[:, :, offset[0]:offset[1]].sum(axis=2)  # every row is in one bin of each feature
    shape = total.shape[:2]
    best = {"gain": np.full(shape, MIN_GAIN), "feature": np.full(shape, -1), "cut": np.zeros(shape, np.int64),
            "default_left": np.zeros(shape, bool), "left": np.zeros((*shape, 3)), "total": total}
    parent = _gain(total[..., 0], total[..., 1])
    for j in range(len(offset) - 1):
        part = hist[:, :, offset[j]:offset[j + 1]]
        lost = part[:, :, -1:]
        below = np.cumsum(part[:, :, :-1], axis=2)  # up to all values: missing ones alone go right
        left = np.concatenate([below, below + lost], axis=2)
        right = total[:, :, None] - left
        gain = _gain(left[..., 0], left[..., 1]) + _gain(right[..., 0], right[..., 1]) - parent[..., None]
        ok = (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows) & (left[..., 1] >= min_weight) & (right[..., 1] >= min_weight)
        gain = np.where(ok, gain, 0.0).round(9)  # equal gains stay equal in whatever order sums were taken
        at = gain.argmax(axis=2)
        here = np.take_along_axis(gain, at[..., None], 2)[..., 0]
        own = np.take_along_axis(left, at[..., None, None], 2)[:, :, 0]
        better = here > best["gain"]
        n = below.shape[2]
        none_lost = lost[:, :, 0, 2] == 0
        side = np.where(none_lost, 2 * own[..., 2] >= total[..., 2], at >= n)
        for name, new in (("gain", here), ("feature", np.full(shape, j)), ("cut", at % n), ("default_left", side)):
            best[name] = np.where(better, new, best[name])
        best["left"] = np.where(better[..., None], own, best["left"])
    best["right"] = total - best["left"]
    return best


def _added(parts):
    """Arrays by key, added up in the order of their numbers."""
    own = {}
    for key, part in parts:
        own.setdefault(key, []).append(part)
    for key, arrays in own.items():
        yield key, sum(a for _, a in sorted(arrays, key=lambda x: x[0]))


def _summed(blocks, job, n_targets: int, n_slots: int, n_bins: int) -> np.ndarray:
    """(outcomes, [gradient, curvature, rows], slots, bins) over all partitions."""
    parts, n = blocks.mapPartitionsWithIndex(job), blocks.getNumPartitions()
    while n > DIRECT_PARTITIONS:
        size, n = DIRECT_PARTITIONS, math.ceil(n / DIRECT_PARTITIONS)
        parts = parts.map(lambda x, size=size: ((x[0], x[1][0] // size), x[1])) \
            .partitionBy(n_targets * n, lambda key, n=n: key[0] * n + key[1]).mapPartitions(_added) \
            .map(lambda x: (x[0][0], (x[0][1], x[1])))
    out = np.zeros((n_targets, 3, n_slots, n_bins))
    for t, sums in parts.partitionBy(n_targets, int).mapPartitions(_added).collect():
        out[t, :, :sums.shape[1]] = sums
    return out


def train_forest(train: DataFrame, features: list[str], targets: list[str], rounds: int, depth: int,
                 learning_rate: float = LEARNING_RATE, max_leaves: int = MAX_LEAVES, max_bins: int = MAX_BINS,
                 min_rows: int = MIN_CHILD_ROWS) -> Forest:
    """Boost all outcomes for ``rounds`` rounds of trees of at most ``depth`` levels and ``max_leaves`` leaves.  Rows with a
    missing outcome are left out.  The first tree of an outcome is one leaf, its log odds."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    given = train.select(*[F.col(c).cast("double").alias(c) for c in features], *[F.col(t).cast("int").alias(t) for t in targets]) \
        .dropna(subset=targets)
    counts = given.agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in targets]).first()
    n = counts["n"]
    if not n:
        raise ValueError("no rows to train on")
    edges = bin_edges(given, features, max_bins)
    missing = np.array([len(e) + 1 for e in edges])
    offset = np.concatenate([[0], np.cumsum(missing + 1)]).astype(np.int64)
    cuts = [np.append(e, np.inf) for e in edges]
    # as many partitions as tasks run at once, or a multiple: a level takes as long as its last wave
    at_once = spark.sparkContext.defaultParallelism
    wanted = max(1, min(math.ceil(n / PARTITION_ROWS), at_once * math.ceil(n / MAX_PARTITION_ROWS / at_once)))
    path = write_table(given.repartition(wanted).mapInArrow(_packed(edges, len(targets)), "n int, data binary"),
                       shared_path(spark, "training-blocks"))
    packed = spark.read.schema("n int, data binary").parquet(path)

    share = np.clip(np.array([counts[t] / n for t in targets]), 1e-6, 1 - 1e-6)
    base = np.log(share / (1 - share))
    n_features, n_targets = len(features), len(targets)
    widths = np.diff(offset)
    groups = joint_features(widths)

    def unpacked(row):
        x = np.frombuffer(row["data"], np.uint8).reshape(-1, row["n"])
        return joint_codes(x[:n_features], groups, widths), x[n_features:], np.repeat(base[:, None], row["n"], axis=1)

    blocks = packed.rdd.coalesce(wanted).map(unpacked).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    out = Forest(features, targets, rounds + 1, depth)
    out.there[:, 0, 0], out.value[:, 0, 0], out.cover[:, 0, 0] = True, base, n
    nodes, kept = 2 ** (depth + 1) - 1, None
    lighter = np.zeros((n_targets, nodes), np.int8)
    for k in range(1, rounds + 1):
        feature, cut = np.full((n_targets, nodes), -1, np.int16), np.zeros((n_targets, nodes), np.int16)
        default_left, value = np.zeros((n_targets, nodes), bool), np.zeros((n_targets, nodes))
        trees, levels, older = (feature, cut, default_left, value), 0, None
        if k > 1:
            older, blocks = blocks, blocks.mapPartitions(update).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            if k % CHECKPOINT_ROUNDS == 0:
                blocks.checkpoint()
        hist, room = np.zeros((n_targets, 1, int(offset[-1]), 3)), [max_leaves - 1] * n_targets
        for level in range(depth):
            # of two children the one with fewer rows is summed; their parent's sums less these are the other one's
            width, above_at = 1 << level, slice((1 << level >> 1) - 1, (1 << level) - 1)
            parents, slots = feature[:, above_at] >= 0, np.full((n_targets, width), -1 if level else 0)
            if level:
                least = 2 * np.arange(width // 2) + lighter[:, above_at]
                np.put_along_axis(slots, least, np.where(parents, np.cumsum(parents, axis=1) - 1, -1), axis=1)
            n_slots = int(slots.max()) + 1
            summed = _summed(blocks, _histograms(trees, level, slots, offset, groups), n_targets, n_slots,
                             int(offset[-1])).transpose(0, 2, 3, 1)
            if level:
                above, hist = hist, np.zeros((n_targets, width, *hist.shape[2:]))
                for t, w in zip(*np.nonzero(parents)):
                    i = least[t, w]
                    hist[t, i] = summed[t, slots[t, i]]
                    hist[t, i ^ 1] = above[t, w] - hist[t, i]
            else:
                hist = summed
            found = best_splits(hist, offset, min_rows)
            if older is not None:
                older.unpersist()
                older = None
                if blocks.isCheckpointed():  # nothing reads the blocks of before any more
                    if kept:
                        remove(spark, kept)
                    kept = blocks.getCheckpointFile()
            first = (1 << level) - 1
            if level == 0:
                out.there[:, k, 0], out.cover[:, k, 0] = True, found["total"][:, 0, 2]
            chosen = []  # a split makes one more leaf; a node that isn't split now stays one
            for t in range(n_targets):
                own = sorted(np.flatnonzero(found["feature"][t] >= 0).tolist(), key=lambda w: (-found["gain"][t, w], w))[:room[t]]
                room[t] -= len(own)
                chosen += [(t, w) for w in sorted(own)]
            for t, w in chosen:
                i, j, c = first + w, int(found["feature"][t, w]), int(found["cut"][t, w])
                if level and not out.there[t, k, i]:
                    continue
                feature[t, i], cut[t, i], default_left[t, i] = j, c, found["default_left"][t, w]
                lighter[t, i] = found["right"][t, w, 2] < found["left"][t, w, 2]
                out.feature[t, k, i], out.threshold[t, k, i], out.default_left[t, k, i] = j, cuts[j][c], default_left[t, i]
                for child, side in ((2 * i + 1, "left"), (2 * i + 2, "right")):
                    g, h, rows = found[side][t, w]
                    value[t, child] = out.value[t, k, child] = learning_rate * g / h
                    out.there[t, k, child], out.cover[t, k, child] = True, rows
                levels = level + 1
            if levels <= level or not any(room):
                break
        update = _update(trees, levels, groups, widths)
    blocks.unpersist()
    for scratch in (kept, path):
        if scratch:
            remove(spark, scratch)
    return out
