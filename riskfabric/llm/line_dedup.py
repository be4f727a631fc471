"""Line dedup: hashes in range partitions, first occurrences streamed, bitmaps out.

Every line whose key is long enough becomes a row (key hash, document,
position).  The rows are range-partitioned on the whole sort order (hash,
document descending, position) and sorted inside each partition, so a line
that a third of all documents hold is cut over as many partitions as its rows
need.  A pass over the sorted rows sees the documents of a key one after
another; the first is the one that keeps its lines.  What a key needs to know
from other partitions (it can only straddle at a partition's ends) is two
rows per partition.  The result is one compressed bitmap per document; texts
are not shuffled to make it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WHITE_BYTES, enter, id_and_text, packed, slices, written

_MASK = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (bytes.lower() leaves other letters)."""
    return line.strip(WHITE_BYTES).lower()


def _entries(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("line_dedup")
        for b in slices(batches):
            h1, h2, doc, tkey, pos = [], [], [], [], []
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for d, t, text in zip(b.column("doc_id").to_pylist(), b.column("tkey").to_pylist(), texts):
                if d is None:
                    continue
                for i, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    # UTF-8 has at most 4 bytes a code point: only keys between need counting
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    h = xxhash.xxh3_128_intdigest(key)
                    h1.append((h >> 64) & _MASK)
                    h2.append(h & _MASK)
                    doc.append(d)
                    tkey.append(t)
                    pos.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(doc, pa.int64()),
                 pa.array(tkey, pa.int64()), pa.array(pos, pa.int32())], names=["h1", "h2", "doc_id", "tkey", "pos"])
    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a sorted partition with, for each, its first
    and last document and its number of distinct documents."""
    runs: list[list] = []  # first run, and the one being read
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(cols[0]):
            continue
        k1, k2, doc = cols
        new_key = np.ones(len(k1), bool)
        new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        starts = np.flatnonzero(new_key)
        counts = np.add.reduceat(new_doc, starts)
        stops = np.append(starts[1:], len(k1))
        for s, e, n in [(starts[i], stops[i], counts[i]) for i in sorted({0, len(starts) - 1})]:
            if runs and runs[-1][0] == k1[s] and runs[-1][1] == k2[s]:
                run = runs[-1]
                run[4] += int(n) - (run[3] == doc[s])
                run[3] = int(doc[e - 1])
            else:
                run = [int(k1[s]), int(k2[s]), int(doc[s]), int(doc[e - 1]), int(n)]
                runs = [*runs[:1], run]
    if runs:
        yield pa.RecordBatch.from_pylist([dict(zip(("h1", "h2", "first_doc", "last_doc", "n_docs"), r)) for r in runs])


def _decide(straddling: dict[tuple[int, int], tuple[int, bool]], min_docs: int):
    """Stream the sorted rows and give those that are dropped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keeper, last, seen, waiting, known = None, None, None, 0, [], None
        for b in batches:
            out = []
            for k1, k2, d, t, p in zip(*(c.to_pylist() for c in b.columns)):
                if (k1, k2) != key:
                    key, waiting = (k1, k2), []
                    known = straddling.get(key)
                    keeper, last, seen = (known[0] if known else d), None, 0
                if d != last:
                    last, seen = d, seen + 1
                if known:
                    if known[1] and d != keeper:
                        out.append((d, t, p))
                elif d != keeper:
                    if seen < min_docs:
                        waiting.append((d, t, p))
                    else:
                        out += waiting
                        waiting = []
                        out.append((d, t, p))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                 pa.array([x[2] for x in out], pa.int32())], names=["doc_id", "tkey", "pos"])
    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, dropped = [], []
        for n, pos in zip(b.column("n_lines").to_pylist(), b.column("positions").to_pylist()):
            keep = np.ones(n, bool)
            keep[np.array(pos or [], np.int64)] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("tkey"), b.column("n_lines"), pa.array(dropped, pa.int64()),
             pa.array(maps, pa.binary())], names=["doc_id", "tkey", "n_lines", "n_dropped", "keep_bitmap"])


def read_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_lines(text: str, bitmap: bytes | None, n_lines: int) -> str:
    """The text without the lines that the bitmap drops."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    return "\n".join(x for x, k in zip(lines, read_bitmap(bitmap, n_lines)) if k)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per (document, text): ``doc_id, tkey, n_lines, n_dropped, keep_bitmap``.

    ``tkey`` is the text's ``xxhash64``; rows repeated with the same id and
    text share one bitmap, and rows of one id with different texts count as
    one document and have a bitmap each.  A null text is one empty line.  A
    row without an id is no document: it is not counted and has no bitmap,
    and ``apply_bitmaps`` leaves it whole.  An empty table gives no rows.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    found = written(base.mapInArrow(_entries(min_chars), "h1 long, h2 long, doc_id long, tkey long, pos int"), "lines")
    order = ["h1", "h2", F.desc("doc_id"), "tkey", "pos"]
    # reliable checkpoint: both passes see the same partitions, and a lost executor can't change them (the
    # lines were written before, since the ranges are drawn from a pass of their own)
    ordered = found.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()

    ends = ordered.mapInArrow(_ends, "h1 long, h2 long, first_doc long, last_doc long, n_docs long").collect()
    met: dict[tuple[int, int], list] = {}
    for r in ends:  # two rows per partition at most
        met.setdefault((r.h1, r.h2), []).append(r)
    straddling = {}
    for key, parts in met.items():
        if len(parts) > 1:
            parts.sort(key=lambda r: (-r.first_doc, -r.last_doc))
            n = parts[0].n_docs
            for a, b in zip(parts, parts[1:]):
                n += b.n_docs - (a.last_doc == b.first_doc)
            straddling[key] = (parts[0].first_doc, n >= min_docs)

    dropped = ordered.mapInArrow(_decide(straddling, min_docs), "doc_id long, tkey long, pos int") \
        .groupBy("doc_id", "tkey").agg(F.collect_set("pos").alias("positions"))
    lengths = base.where("doc_id is not null").select(
        "doc_id", "tkey", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines")) \
        .dropDuplicates(["doc_id", "tkey"])
    # written: what reads the bitmaps then has one Python worker a task, not two
    return written(lengths.join(dropped, ["doc_id", "tkey"], "left").select(
        "doc_id", "tkey", F.col("n_lines").cast("long").alias("n_lines"), "positions")
        .mapInArrow(_bitmaps, "doc_id long, tkey long, n_lines long, n_dropped long, keep_bitmap binary"), "bitmaps")


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps as arrays that expressions read."""
    for b in batches:
        keep = [read_bitmap(m, n) for m, n in zip(b.column("keep_bitmap").to_pylist(), b.column("n_lines").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(keep, pa.list_(pa.bool_()))],
                                         names=["doc_id", "tkey", "keep"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines gone from its text; all columns and rows stay.
    Texts that lose nothing, null ones included, stay as they are.  Only bitmaps pass through
    Python; texts are cut by expressions."""
    masks = bitmaps.where("n_dropped > 0").select("doc_id", "tkey", "n_lines", "keep_bitmap") \
        .mapInArrow(_masks, "doc_id long, tkey long, keep array<boolean>")
    rows = packed(docs).withColumn("doc_id", F.col(f"doc.`{id_col}`").cast("long")) \
        .withColumn("tkey", F.xxhash64(F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))))
    joined = rows.join(masks, ["doc_id", "tkey"], "left")
    text = F.col(f"doc.`{text_col}`")
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: F.get(F.col("keep"), i))
    text = F.when(F.col("keep").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in slices(batches):
        sha = []
        for t, m, n in zip(b.column("text").to_pylist(), b.column("keep_bitmap").to_pylist(), b.column("n_lines").to_pylist()):
            sha.append(hashlib.sha256(keep_lines(t, m, n).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in ("doc_id", "n_lines", "n_dropped")] + [pa.array(sha)],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_sha256``.  A null text is one
    empty line; a row without an id keeps all lines; other columns play no part."""
    base = id_and_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    maps = line_bitmaps(docs, id_col, text_col, **rule)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    joined = base.join(maps.drop("n_lines"), ["doc_id", "tkey"], "left").select(
        "doc_id", "text", lines.cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("n_dropped") > 0, F.col("keep_bitmap")).alias("keep_bitmap"))
    return joined.mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
  translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs)
