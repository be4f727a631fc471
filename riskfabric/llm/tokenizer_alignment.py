"""Cross-tokenizer alignment over exactly deduplicated texts.

Texts are shuffled by the whole text, so copies meet and each distinct text is
tokenised by both tokenizers and aligned once, whatever the number of its
copies.  Byte offsets where tokens of A and B both end cut a text into groups;
an A and a B token are linked where their byte ranges overlap.

Neither tokenizer merges across a single space between two characters that
aren't white space, so both end a token there: a text is the sequence of such
units, and a unit's tokens, groups and links are the same wherever it stands.
A task therefore aligns each unit once while it stays cached, a batch of units
by numpy, and puts texts together from units.

Counts of id pairs never meet texts as rows of (text, pair).  A task works on
slices of texts of bounded size and returns a slice's distinct pairs with the
number of documents (weighted by copies).  Spark sums them per pair, finds each
A id's highest count and gives the totals back to the slices by a join of
(slice, pair); a slice and its pairs then meet in one small group.  Measures of
the distinct texts finally join the documents by the text's SHA-256.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from ._common import SLICE_BYTES, TwoGenerations, held, id_and_text, slices, written

#: Both neighbours of a cut are no white space (Python's class holds the tokenizers' classes).
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
_BYTE = re.compile("<0x([0-9A-F]{2})>")
#: Units that are aligned at once.
BATCH_UNITS = 20_000

#: The byte-level tokenizer's character for each byte: printable ones stand for themselves, the rest follow from 256 on.
_SAME = {*range(33, 127), *range(161, 173), *range(174, 256)}
_CHAR_BYTES = {chr(b if b in _SAME else 256 + k - len([x for x in _SAME if x < b])): b for k, b in enumerate(range(256))}


def byte_level_tokens(tokenizer: Tokenizer) -> list[bytes]:
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        known = all(c in _CHAR_BYTES for c in token)
        out[i] = bytes(_CHAR_BYTES[c] for c in token) if known else token.encode()
    return out


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        m = _BYTE.fullmatch(piece)
        out.append(bytes([int(m[1], 16)]) if m else piece.replace(_SPACE, " ").encode())
    return out


def _decimals(n: int) -> np.ndarray:
    """Each id's decimal digits and room for a separator, zero bytes between."""
    width = len(str(max(n - 1, 0)))
    return np.array([str(i).encode() for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges, one range after another."""
    total = int(counts.sum())
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts - starts, counts)


class Aligner:
    """Both tokenizers and the units met so far: a unit's number indexes its counts, group text and pairs."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = byte_level_tokens(self.a), piece_tokens(self.b)
        if any(" " in p.lstrip(" ") for p in (t.decode("latin-1") for t in self.bytes_b)):
            raise ValueError("pieces that reach over a space: texts can't be cut into units")
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.dec_a, self.dec_b = _decimals(len(self.bytes_a)), _decimals(len(self.bytes_b))
        #: unit -> (A tokens, B tokens, groups, group text, pairs); None where the bytes differ
        self.units = TwoGenerations(150_000)

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)]
        return a, self.b.encode(units, num_threads=1)

    def learn(self, units: list[str]) -> None:
        step = BATCH_UNITS
        for i in range(0, len(units), step):
            part = units[i:i + step]
            a, b = self.encode(part)
            whole = [f" {u}".encode() for u in part]
            good = [b"".join(map(self.bytes_a.__getitem__, x)) == w and b"".join(map(self.bytes_b.__getitem__, y)) == w
                    for x, y, w in zip(a, b, whole)]
            for u, ok in zip(part, good):
                if not ok:
                    self.units[u] = None
            keep = [k for k, ok in enumerate(good) if ok]
            found = self.align([a[k] for k in keep], [b[k] for k in keep], [len(whole[k]) for k in keep])
            for k, x in zip(keep, found):
                self.units[part[k]] = x

    def align(self, a: list, b: list, sizes: list[int]) -> list[tuple]:
        """Groups and links of units whose tokens spell the same bytes."""
        if not a:
            return []
        na, nb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        ids_a, ids_b = (np.fromiter((t for x in y for t in x), np.int64, int(n.sum())) for y, n in ((a, na), (b, nb)))
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        ends = np.cumsum(sizes)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)  # unit ends are among them
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_groups = np.diff(np.searchsorted(cuts, ends, side="right"), prepend=0)
        # links: the B tokens from the one that holds A's first byte to the one that holds its last
        first = np.searchsorted(end_b, end_a - self.len_a[ids_a], side="right")
        count = np.searchsorted(end_b, end_a, side="left") - first + 1
        pairs = np.repeat(ids_a << 32, count) | ids_b[_ranges(first, count)]
        links = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(na)])]
        # the group text: A ids, then B ids of each group, every id with the mark behind it
        group = np.concatenate([group_a, group_b])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.lexsort((side, group))  # stable: tokens stay in order
        width = max(self.dec_a.shape[1], self.dec_b.shape[1])
        cells = np.zeros((len(group), width + 1), np.uint8)
        cells[:len(ids_a), :self.dec_a.shape[1]] = self.dec_a[ids_a]
        cells[len(ids_a):, :self.dec_b.shape[1]] = self.dec_b[ids_b]
        cells = cells[order]
        g, s = group[order], side[order]
        last = np.ones(len(g), bool)
        last[:-1] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        cells[:, width] = np.where(last, np.where(s == 0, ord("|"), ord(";")), ord(","))
        used = cells != 0
        text = cells[used].tobytes()
        at = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[np.concatenate([[0], np.cumsum(na + nb)])].tolist()
        raw, link_at = pairs.tobytes(), (8 * links).tolist()
        return [(x, y, z, text[at[k]:at[k + 1]], raw[link_at[k]:link_at[k + 1]])
                for k, (x, y, z) in enumerate(zip(na.tolist(), nb.tolist(), n_groups.tolist()))]

    def texts(self, texts: list[str]) -> list[tuple | None]:
        """Per text (A tokens, B tokens, groups, SHA-256 of the group text, pairs), None where the bytes differ."""
        cut = [_CUT.split(t) for t in texts]
        self.units.begin()
        self.learn(self.units.missing(set().union(*cut)))
        get, out = self.units.__getitem__, []
        for units in cut:
            got = list(map(get, units))
            if None in got:
                out.append(None)
                continue
            na, nb, groups, marks, pairs = zip(*got)
            sha = hashlib.sha256(b"".join(marks)[:-1]).hexdigest()
            out.append((sum(na), sum(nb), sum(groups), sha, np.frombuffer(b"".join(pairs), np.int64)))
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held("tokenizer_alignment", (path_a, path_b), lambda: Aligner(path_a, path_b))


_ALIGNED = "slice long, key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
           "links binary, pairs array<long>, docs array<long>"
_MEASURES = "key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _pack(at: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted places and how often each stands there."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _aligned(path_a: str, path_b: str, slice_bytes: int):
    """A row per text, and behind each slice's texts a row with its distinct pairs and their documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, part, n = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        schema = pa.schema([("slice", pa.int64()), ("key", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                            ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                            ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
        for batch in slices(batches, size=slice_bytes):
            number, n = (part << 32) | n, n + 1
            found = work.texts(batch.column("text").to_pylist())
            kept = [(k, w, *f) for k, w, f in zip(batch.column("key").to_pylist(), batch.column("weight").to_pylist(), found) if f]
            if not kept:
                continue
            own = [np.unique(x[-1], return_counts=True) for x in kept]
            pairs = np.unique(np.concatenate([p for p, _ in own]))
            docs = np.zeros(len(pairs), np.int64)
            rows = []
            for (key, weight, na, nb, groups, sha, links), (p, times) in zip(kept, own):
                at = np.searchsorted(pairs, p)
                docs[at] += weight
                rows.append({"slice": number, "key": key, "n_a": na, "n_b": nb, "n_groups": groups, "n_links": len(links),
                             "groups_sha256": sha, "links": _pack(at, times)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]) if f.name == "slice" else pa.array([pairs], f.type) if f.name == "pairs"
                 else pa.array([docs], f.type) if f.name == "docs" else pa.nulls(1, f.type) for f in schema], schema=schema)
    return run


def _measured(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """A slice's texts with the corpus-wide totals of its pairs."""
    pos = pairs.column("pos").to_numpy()
    total, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    total[pos], best[pos] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
    n_best, count_sum = [], []
    for data in texts.column("links").to_pylist():
        at, times = _unpack(data)
        n_best.append(int((best[at] * times).sum()))
        count_sum.append(int((total[at] * times).sum()))
    return pa.table({**{c: texts.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links")},
                     "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
                     "groups_sha256": texts.column("groups_sha256")})


def _key(text: str = "text"):
    return F.sha2(F.col(text), 256)


def aligned_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None,
                  path_b: str | None = None, slice_bytes: int = 2 * SLICE_BYTES) -> DataFrame:
    """The written table of distinct texts: a row per text with its measures and links, and
    a row per slice with its distinct pairs (``a << 32 | b``) and their documents."""
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    texts = id_and_text(docs, id_col, text_col).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("weight"))
    return written(texts.select(_key().alias("key"), "text", "weight").mapInArrow(
        _aligned(path_a, path_b, slice_bytes), _ALIGNED), "aligned-texts")


def pair_totals(aligned: DataFrame) -> DataFrame:
    """``pair, total, best``: documents that hold the id pair linked, and 1 where no pair of the
    same A id is in more.  An A id has no more partners than B has ids, which bounds the window."""
    given = aligned.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "docs")))
    sums = given.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("total"))
    top = F.max("total").over(W.partitionBy(F.shiftright("pair", 32)))
    return sums.select("pair", "total", (F.col("total") == top).cast("int").alias("best"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Null and empty texts, and texts that one of the tokenizers doesn't spell byte by byte, have no
    tokens: zeros, and an empty ``groups_sha256``.  Repeated rows, and rows without an id, are
    documents like others and each have a row; an empty table gives none.  Other columns play no
    part, whatever their names.  Very long texts are a slice of their own.
    """
    aligned = aligned_texts(docs, id_col, text_col, **settings)
    asked = aligned.where("pairs is not null").select(F.col("slice").alias("of"), F.posexplode("pairs").alias("pos", "pair"))
    totals = asked.join(pair_totals(aligned), "pair").select("of", F.col("pos").cast("long").alias("pos"), "total",
                                                              F.col("best").cast("long").alias("best"))
    texts = aligned.where("pairs is null").select(
        "slice", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    measured = texts.groupBy("slice").cogroup(totals.groupBy("of")).applyInArrow(_measured, _MEASURES)
    base = id_and_text(docs, id_col, text_col).select("doc_id", _key().alias("key"))
    zero = F.lit(0).cast("long")
    return base.join(measured, "key", "left").select(
        "doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignment(docs)
