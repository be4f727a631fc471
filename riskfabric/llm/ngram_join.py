"""Similarity join on word n-grams by vertical partitioning.

The order of all n-grams (their 64-bit hashes) is cut into fragments, and a
document's sorted set into one segment per fragment.  A fragment sees all
documents' n-grams in its range, so it counts alone how many documents share
each of them; a document's shared n-grams are then summed over fragments.  A
partner must hold at least 80 % of a document's set, so documents with fewer
shared n-grams are linked with nothing and go (twice: what has gone no longer
counts as sharing).  Documents with the same set are one class from here on.

What is left is joined by prefixes: under the global order (rarest first, then
by hash) two linked sets share an n-gram within the first ``n - ceil(0.8 n) + 1``
of each.  Documents that share prefixes with the same leader form blocks of
bounded size.  Overlaps are counted in blocks, one fragment of columns at a
time, and the partial counts are summed per pair.  Hub documents of a large
group visit all its blocks, so a group of many near copies grows together
without all of its pairs being compared.  Then only blocks that share a
prefix across two components are compared with each other.  A block gives a
spanning set of its links; components of these are the components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import TwoGenerations, enter, give_back, id_and_text, slices, written
from .components import connected_components

WORDS = 5
PERCENT = 80
BLOCK = 256            # documents of a block
BLOCK_BYTES = 8 << 20  # n-gram hashes of a block
HUBS = 64
COLUMNS = 8192         # n-grams of a fragment inside a block

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(a)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(b)
    return x ^ (x >> np.uint64(31))


_WORDS = TwoGenerations(60_000)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    words = text.lower().split()
    for w in _WORDS.missing(set(words)):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text; with fewer words, the whole sequence is one."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(len(w), WORDS)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h += w[k:len(w) - n + 1 + k] * _MULT[k]
    return np.unique(_mix(h + np.uint64(n), 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array whose values are runs of ``data`` (8 bytes an item)."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * 8, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 8-byte items of a binary column in a row, and their number per value."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(np.uint64) if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint64)
    return flat, np.diff(offsets).astype(np.int64) // 8


def _signature(grams: np.ndarray) -> tuple[int, int]:
    """Two XOR hashes of a set."""
    x1 = np.bitwise_xor.reduce(_mix(grams, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
    x2 = np.bitwise_xor.reduce(_mix(grams ^ np.uint64(0x5851F42D4C957F2D), 0x9FB21C651E98DF25, 0xD1342543DE82EF95))
    return int(np.int64(x1.view(np.int64))), int(np.int64(x2.view(np.int64)))


def _segments(fragments: int):
    """The segments of a slice of documents, in one row per fragment: the documents that have
    n-grams there (ids, places in the slice, numbers of n-grams) and these n-grams, so a row
    costs no more than a multiple of its n-grams.  The first fragment's row also has the ids
    and set signatures of all documents of the slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram_join")
        part, number = TaskContext.get().partitionId(), 0
        for b in slices(batches, size=3 << 19):
            _WORDS.begin()
            ids, sets = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                s = shingles(t)
                if len(s) and d is not None:
                    ids.append(d)
                    sets.append(s)
            if not ids:
                continue
            flat = np.concatenate(sets)
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(s) for s in sets])
            frag = ((flat >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(frag, kind="stable")
            flat, doc, frag = flat[order], doc[order], frag[order]
            cuts = np.searchsorted(frag, np.arange(fragments + 1))
            rows = []
            every = np.array(ids, np.int64)
            signed = np.array([_signature(s) for s in sets], np.int64).tobytes()
            for f in range(fragments):
                lo, hi = int(cuts[f]), int(cuts[f + 1])
                if hi > lo or f == 0:
                    here, n = np.unique(doc[lo:hi], return_counts=True)  # n-grams of a fragment lie in the order of documents
                    rows.append((f, part << 32 | number, every[here].tobytes(), here.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(),
                                 flat[lo:hi].tobytes(), every.tobytes() if f == 0 else None, signed if f == 0 else None))
            number += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                names=["frag", "slice", "docs", "pos", "n", "grams", "ids", "signed"])
    return run


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
            if i and held:
                yield pa.Table.from_batches(held)
                held = []
            if e > s:
                held.append(b.slice(s, e - s))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    give_back()


def _count_shared(flat: np.ndarray) -> np.ndarray:
    """For each n-gram of a fragment the number of documents that have it, 0 if it is one."""
    s = np.sort(flat)
    many = np.unique(s[1:][s[1:] == s[:-1]])
    count = np.searchsorted(s, many, "right") - np.searchsorted(s, many)
    del s
    df = np.zeros(len(flat), np.int32)
    for a in range(0, len(flat) if len(many) else 0, 1 << 18):  # what is made on the way stays small
        part = flat[a:a + (1 << 18)]
        k = np.minimum(np.searchsorted(many, part), len(many) - 1)
        df[a:a + (1 << 18)] = np.where(many[k] == part, count[k], 0)
    return df


def _ints(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for c in column.chunks for x in c.to_pylist()]


def _sums(flags: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over runs of lengths ``n``, which may be 0."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice and fragment: the documents' n-grams (n), how many of them other
    documents have too (u), and the shared ones."""
    for t in _by_key(batches, ["frag"]):
        frag = t.column("frag")[0].as_py()
        docs, n = _ints(t.column("docs"), np.int64), [x.astype(np.int64) for x in _ints(t.column("n"), np.int32)]
        flat = np.concatenate([_items(c)[0] for c in t.column("grams").chunks])
        who, size = np.concatenate(docs), np.concatenate(n)
        ids, times = np.unique(who, return_counts=True)
        if (times > 1).any():  # rows repeated with one id: their united set, each n-gram where it comes first
            owner = np.repeat(who, size)
            at = np.flatnonzero(np.isin(owner, ids[times > 1]))
            order = at[np.lexsort((at, flat[at], owner[at]))]
            again = order[1:][(flat[order[1:]] == flat[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])]
            keep = np.ones(len(flat), bool)
            keep[again] = False
            size = _sums(keep, size)
            flat = flat[keep]
        df = _count_shared(flat)
        u = _sums(df > 0, size)
        hit = df > 0
        grams, counts = flat[hit], df[hit]
        lens = [len(x) for x in docs]
        at, taken = np.cumsum([0, *lens]), 0
        for i in range(len(docs)):
            ni, ui = size[at[i]:at[i + 1]], u[at[i]:at[i + 1]]
            k = int(ui.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([frag], pa.int32()), *[t.column(c).slice(i, 1).combine_chunks() for c in ("slice", "docs", "pos")],
                 pa.array([ni.astype(np.int32).tobytes()], pa.binary()), pa.array([ui.astype(np.int32).tobytes()], pa.binary()),
                 pa.array([grams[taken:taken + k].tobytes()], pa.binary()), *[t.column(c).slice(i, 1).combine_chunks() for c in ("ids", "signed")]],
                names=["frag", "slice", "docs", "pos", "n", "u", "grams", "ids", "signed"])
            taken += k


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a slice's documents, summed over fragments, and their signatures."""
    for t in _by_key(batches, ["slice"]):
        docs = np.frombuffer(next(x for x in t.column("ids").to_pylist() if x is not None), np.int64)
        n, u = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for pos, more_n, more_u in zip(*(_ints(t.column(c), np.int32) for c in ("pos", "n", "u"))):
            n[pos] += more_n  # a fragment has a document once
            u[pos] += more_u
        x = np.frombuffer(next(x for x in t.column("signed").to_pylist() if x is not None), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs), pa.array(np.full(len(docs), t.column("slice")[0].as_py())), pa.array(n), pa.array(u),
             pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["doc_id", "slice", "n", "u", "x1", "x2"])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared segments of a slice, its wanted documents' only."""
    for b in batches:
        rows = []
        for frag, part, docs, u, grams, wanted in zip(*(b.column(c).to_pylist() for c in ("frag", "slice", "docs", "u", "grams", "wanted"))):
            docs, u, flat = np.frombuffer(docs, np.int64), np.frombuffer(u, np.int32).astype(np.int64), np.frombuffer(grams, np.uint64)
            keep = np.isin(docs, np.array(wanted, np.int64)) & (u > 0)
            if keep.any():
                rows.append((frag, part, docs[keep].tobytes(), u[keep].astype(np.int32).tobytes(), flat[np.repeat(keep, u)].tobytes()))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                                             names=["frag", "slice", "docs", "u", "grams"])


def _shared_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice and fragment: the documents' n-grams that other wanted documents have too, with their counts."""
    for t in _by_key(batches, ["frag"]):
        docs, u = _ints(t.column("docs"), np.int64), [x.astype(np.int64) for x in _ints(t.column("u"), np.int32)]
        flat = np.concatenate([_items(c)[0] for c in t.column("grams").chunks])
        df = _count_shared(flat)
        at = 0
        for i, (who, size) in enumerate(zip(docs, u)):
            n = int(size.sum())
            own, own_df, at = flat[at:at + n], df[at:at + n], at + n
            hit = own_df > 0
            yield pa.RecordBatch.from_arrays(
                [t.column("slice").slice(i, 1).combine_chunks(), pa.array([who.tobytes()], pa.binary()),
                 pa.array([_sums(hit, size).astype(np.int32).tobytes()], pa.binary()), pa.array([own[hit].tobytes()], pa.binary()),
                 pa.array([own_df[hit].astype(np.int64).tobytes()], pa.binary())], names=["slice", "docs", "u", "grams", "df"])


def _again_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a slice, each with its n-grams of all fragments."""
    for t in _by_key(batches, ["slice"]):
        who = np.concatenate([np.repeat(d, n) for d, n in zip(_ints(t.column("docs"), np.int64), _ints(t.column("u"), np.int32))])
        flat, df = (np.concatenate(_ints(t.column(c), k)) for c, k in (("grams", np.uint64), ("df", np.int64)))
        order = np.argsort(who, kind="stable")
        ids, n = np.unique(who, return_counts=True)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), _binary(flat[order], n), _binary(df[order], n)],
                                             names=["doc_id", "u", "seg", "df"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole shared set of a document and its prefix under the order (count, hash).
    N-grams that nobody shares come first of all, so they take their places in it."""
    for b in batches:
        sets, prefixes = [], []
        for n, segs, dfs in zip(b.column("n").to_pylist(), b.column("segs").to_pylist(), b.column("dfs").to_pylist()):
            s = np.concatenate([np.frombuffer(x, np.uint64) for x in segs])
            df = np.concatenate([np.frombuffer(x, np.int64) for x in dfs])
            places = n - (PERCENT * n + 99) // 100 + 1 - (n - len(s))
            prefixes.append(s[np.lexsort((s, df))[:max(0, places)]].view(np.int64))
            sets.append(np.sort(s).tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n"), pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
            names=["doc_id", "n", "grams", "prefix"])


def _links(sets: list[np.ndarray], n: np.ndarray, comp: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links (pairs of positions) that span what all links of the block connect;
    pairs that are connected already, or on the same side, aren't looked at."""
    k = len(sets)
    flat, who = np.concatenate(sets), np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.append(True, flat[1:] != flat[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(flat)))
    col = np.cumsum(new) - 1
    keep = count[col] > 1  # what one document alone has can't overlap
    who, col = who[keep], np.cumsum(count > 1)[col[keep]] - 1
    total = int(col[-1]) + 1 if len(col) else 0
    overlap = np.zeros((k, k), np.float32)
    for a in range(0, total, COLUMNS):  # partial overlaps of a fragment of the order
        lo, hi = np.searchsorted(col, [a, a + COLUMNS])
        m = np.zeros((k, min(COLUMNS, total - a)), np.float32)
        m[who[lo:hi], col[lo:hi] - a] = 1
        overlap += m @ m.T
    o = np.rint(overlap).astype(np.int64)
    linked = 100 * o >= PERCENT * (n[:, None] + n[None, :] - o)
    linked &= comp[:, None] != comp[None, :]
    if side is not None:
        linked &= side[:, None] != side[None, :]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1)))):
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _compare(keys: list[str]):
    """Links of blocks: rows of ``keys``, doc_id, n, comp, side and grams, sorted by ``keys``.
    The number of sides tells whether pairs inside the block count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, keys):
            if t.num_rows < 2:
                continue
            doc, n, comp, side = (t.column(c).to_numpy() for c in ("doc_id", "n", "comp", "side"))
            _, once = np.unique(doc, return_index=True)  # a hub also visits its own block
            sets = [np.frombuffer(t.column("grams")[int(i)].as_py(), np.uint64) for i in once]
            doc, n, comp, side = doc[once], n[once], comp[once], side[once]
            pairs = _links(sets, n, comp, side if (side != side[0]).any() else None)
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(doc[b])], names=["a", "b"])
    return run


def _blocks(docs: DataFrame, group: list[str]) -> DataFrame:
    """``docs`` with ``parts`` (blocks that its group is cut into) and ``part`` (its own)."""
    sizes = docs.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("group_bytes"))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("group_bytes") / BLOCK_BYTES)).cast("int")
    return docs.join(sizes.withColumn("parts", parts), group) \
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                              fragment_items: int = 1 << 21) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Null, empty and white texts have no set and are components of their own.
    Rows without an id have neither set nor component.  Rows repeated with
    one id count as one document (of their united set, if the texts differ).
    Other columns play no part.
    """
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col)
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    cores = 2 * spark.sparkContext.defaultParallelism
    fragments = max(cores if chars > 1 << 20 else 2, -(-chars // (6 * fragment_items)))
    segments = base.mapInArrow(_segments(fragments), "frag int, slice long, docs binary, pos binary, n binary, grams binary, ids binary, signed binary")
    table = written(segments.repartitionById(fragments, "frag").sortWithinPartitions("frag").mapInArrow(
        _shared, "frag int, slice long, docs binary, pos binary, n binary, u binary, grams binary, ids binary, signed binary"), "ngram-segments")

    by_slice = table.select("slice", "pos", "n", "u", "ids", "signed").repartition("slice").sortWithinPartitions("slice") \
        .mapInArrow(_by_document, "doc_id long, slice long, n long, u long, x1 long, x2 long")
    one = (F.min("x1") == F.max("x1")) & (F.min("x2") == F.max("x2"))  # else rows of one id differ: a set of its own
    stats = by_slice.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("u").alias("u"), F.collect_set("slice").alias("slices"),
                                           F.when(one, F.min("x1")).otherwise(F.xxhash64("doc_id")).alias("x1"),
                                           F.when(one, F.min("x2")).otherwise(F.xxhash64(F.lit(2), "doc_id")).alias("x2"))
    stats = written(stats, "ngram-sets")
    alive = F.expr(f"100 * u >= {PERCENT} * n")
    classes = stats.where(alive).groupBy("n", "x1", "x2").agg(F.min("doc_id").alias("rep"))
    members = stats.where(alive).join(classes, ["n", "x1", "x2"]).select("doc_id", "rep")
    reps = written(stats.where(alive).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
                   .select("doc_id", F.col("n").alias("size"), "u", "slices"), "ngram-reps")

    wanted = reps.select("doc_id", F.explode("slices").alias("slice")).groupBy("slice").agg(F.collect_list("doc_id").alias("wanted"))
    again = table.select("frag", "slice", "docs", "u", "grams").join(wanted, "slice") \
        .mapInArrow(_wanted, "frag int, slice long, docs binary, u binary, grams binary") \
        .repartition("frag").sortWithinPartitions("frag") \
        .mapInArrow(_shared_again, "slice long, docs binary, u binary, grams binary, df binary")
    table = written(again.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        _again_by_document, "doc_id long, u long, seg binary, df binary"), "ngram-again")
    whole = table.where("u > 0").groupBy("doc_id").agg(F.sum("u").alias("u"), F.collect_list("seg").alias("segs"),
                                                       F.collect_list("df").alias("dfs")) \
        .join(reps.select("doc_id", F.col("size").alias("n")), "doc_id").where(alive).select("doc_id", "n", "segs", "dfs")
    sets = written(whole.mapInArrow(_prefixes, "doc_id long, n long, grams binary, prefix array<long>"), "ngram-prefixes")

    rows = sets.select("doc_id", F.explode("prefix").alias("gram"))
    leaders = rows.groupBy("gram").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    rows = written(rows.join(leaders, "gram"), "ngram-buckets")
    led = rows.groupBy("doc_id", "leader").agg(F.count(F.lit(1)).alias("c")) \
        .groupBy("doc_id").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
    # blocks are made of small rows; the n-grams join when a block meets
    grams = sets.select("doc_id", "grams")
    docs1 = written(_blocks(sets.select("doc_id", "n", F.length("grams").alias("bytes")).join(led, "doc_id"), ["leader"]), "ngram-docs")

    # inside blocks, with the hubs of their group
    hub = (F.col("parts") > 1) & (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.ceil(F.col("size") / HUBS)) == 0)
    visits = F.when(hub, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    schema = "a long, b long"
    inside = docs1.where("size > 1").select("leader", F.explode(visits).alias("part"), "doc_id", "n", F.col("doc_id").alias("comp"),
                                            F.lit(0).alias("side")).join(grams, "doc_id")
    keys = ["leader", "part"]
    first = written(inside.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(keys), schema), "ngram-links")

    # between blocks that share a prefix across components
    comps = connected_components(first)
    placed = docs1.select("doc_id", "n", "bytes", "leader").join(
        comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    big = placed.groupBy("leader", "comp").agg(F.count(F.lit(1)).alias("c")).where("c >= 64").select(
        "leader", "comp", F.col("comp").alias("own"))
    placed = placed.join(big, ["leader", "comp"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    docs2 = written(_blocks(placed, ["leader", "own"]).withColumn("block", F.xxhash64("leader", "own", "part"))
                    .select("doc_id", "n", "comp", "block"), "ngram-docs2")
    at = rows.select("gram", "doc_id").join(docs2.select("doc_id", "comp", "block"), "doc_id")
    met = at.groupBy("gram", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = met.groupBy("gram").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("gram")
    met = written(met.join(mixed, "gram", "left_semi"), "ngram-met")
    x, y = met.alias("x"), met.alias("y")
    pairs = x.join(y, "gram").where("x.block <= y.block and (x.lo <> x.hi or y.lo <> y.hi or x.lo <> y.lo)") \
        .where("x.block < y.block or x.lo <> x.hi").select(F.col("x.block").alias("p"), F.col("y.block").alias("q")).distinct()
    pairs = written(pairs, "ngram-pairs")
    cols = ["doc_id", "n", "comp"]
    left = pairs.join(docs2, pairs["p"] == docs2["block"]).select("p", "q", *cols, F.lit(0).alias("side"))
    right = pairs.where("p <> q").join(docs2, F.col("q") == docs2["block"]).select("p", "q", *cols, F.lit(1).alias("side"))
    keys = ["p", "q"]
    second = left.unionByName(right).join(grams, "doc_id").repartition(*keys).sortWithinPartitions(*keys) \
        .mapInArrow(_compare(keys), schema)
    links = first.unionByName(written(second, "ngram-links2"))
    comps = connected_components(links)

    # every document takes the component of its class's first document
    found = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id"))
    return base.select("doc_id").join(stats.select("doc_id", "n"), "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicate_components(docs)
