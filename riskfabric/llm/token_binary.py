"""Token ids in a bit-packed binary format.

Documents are range-partitioned by id, so partitions follow each other in
ascending id order; each task encodes its documents and packs the ids into
shard images of about ``SHARD_IDS`` ids.  An image is self-contained:

    magic "TBP1" | u32 bits per id | u32 ids per block | u64 ids | u64 documents | u64 blocks
    u64 byte offset of each block, from the image's start, and the end
    i64 id of each document | u64 first id of each document, and the end | u8 id known
    blocks: ids in the minimum bits of the vocabulary, lowest bit first, byte-aligned per block

All integers are little-endian.  Block offsets give random access: only the
blocks that a range touches are unpacked, with numpy.  Images are rows of a
Parquet table in the shared folder, because Spark's writers reach any store
and commit once per task however often a task is tried again.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from ._common import TwoGenerations, chunks, held, id_and_text, slices, written

MAGIC = b"TBP1"
HEAD = struct.Struct("<4sIIQQQ")
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 20


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:  # the general layout at this width
        return ids.astype("<u2").tobytes()
    planes = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_image(doc_ids: list, ids: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    blocks = [pack(flat[i:i + block_ids], bits) for i in range(0, len(flat), block_ids)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    body = HEAD.size + 8 * (len(blocks) + 1) + docs.nbytes + starts.nbytes + known.nbytes
    offsets = (body + np.concatenate([[0], np.cumsum([len(x) for x in blocks])])).astype("<u8")
    head = HEAD.pack(MAGIC, bits, block_ids, len(flat), len(docs), len(blocks))
    return b"".join([head, offsets.tobytes(), docs.tobytes(), starts.tobytes(), known.tobytes(), *blocks])


class Image:
    """A shard image, read without copying; ``ids(start, stop)`` unpacks only the blocks it needs."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block_ids, self.n_ids, n_docs, n_blocks = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token image")
        at = HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(self.data, kind, n, at)
            at += out.nbytes
            return out
        self.offsets, self.docs = take("<u8", n_blocks + 1), take("<i8", n_docs)
        self.starts, self.known = take("<u8", n_docs + 1), take(np.uint8, n_docs)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self.data[int(self.offsets[k]):int(self.offsets[k + 1])], self.bits, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(a, b + 1)])
        return got[start - a * self.block_ids:stop - a * self.block_ids]


#: Words that the pre-tokenizer is sure to cut into their letters and one run of marks. Letters
#: of ISO 8859-1 have one composed form and one lower case, so a core may be lower-cased first.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|#$%&*]*)")

#: The tokenizer's character for each byte: printable ones stand for themselves, the rest follow from 256 on.
_SAME = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: b if b in _SAME else 256 + k - len([x for x in _SAME if x < b]) for k, b in enumerate(range(256))}


class Known(TwoGenerations):
    """What ``make`` gives for each key, made when it is first asked for: a token costs one look-up."""

    def __init__(self, limit: int, make):
        super().__init__(limit)
        self.make = make

    def __missing__(self, key) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        self[key] = ids
        return ids


class WordEncoder:
    """Encodes white-space-separated words, each once while it stays cached.

    The tokenizer drops white space and never merges across it, so the ids of
    a text are those of its words one after another.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.vocab_size = self.tokenizer.model, self.tokenizer.get_vocab_size()
        self.words, self.pieces = Known(200_000, self._word), Known(150_000, self._piece)

    def _piece(self, piece: str) -> bytes:
        # nothing is left to normalise or to cut in such a piece: it goes to the tokenizer's model
        chars = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        found = self.model.tokenize(chars)
        return array("I", [t.id for t in found]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        m = _PLAIN.fullmatch(text)
        if m:
            core, marks = m.groups()
            return self.pieces[core.lower()] + self.pieces[marks] if marks else self.pieces[core.lower()]
        coded, = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array("I", coded.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        self.words.begin()
        self.pieces.begin()
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, t.split())), "<u4") for t in texts]


def word_encoder(path: str) -> WordEncoder:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held("token_binary", path, lambda: WordEncoder(path))


def _images(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        bits, part = bits_for(encoder.vocab_size), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        docs, ids, held, before, shard = [], [], 0, 0, 0

        def image():
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "part_start": before, "n_ids": held,
                                                "image": write_image(docs, ids, bits)}], schema=schema)
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()),
                            ("n_ids", pa.int64()), ("image", pa.binary())])
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            if len(texts) == 1:
                coded = [np.concatenate([x for c in chunks(texts[0]) for x in encoder.encode([c])])]
            else:
                coded = encoder.encode(texts)
            for d, x in zip(b.column("doc_id").to_pylist(), coded):
                docs.append(d)
                ids.append(np.concatenate([x, end]))
                held += len(x) + 1
                if held >= SHARD_IDS:
                    yield image()
                    docs, ids, before, held, shard = [], [], before + held, 0, shard + 1
        if docs:
            yield image()
    return run


def write_token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                    end_id: int = 2) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the images; returns the
    written table ``part, shard, part_start, n_ids, image``, whose ids follow each
    other by (part, shard).  Null and empty texts have the end id alone; rows
    without an id come first; rows repeated are each written; other columns play no part."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    base = id_and_text(docs, id_col, text_col)
    # texts are dealt out before they are encoded: the sampling for the ranges then only scans
    order = ["doc_id", F.xxhash64("text")]
    ordered = base.repartitionByRange("doc_id").sortWithinPartitions(*order)
    return written(ordered.mapInArrow(_images(path, end_id), "part int, shard int, part_start long, n_ids long, image binary"),
                   "token-images")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            image = Image(b.column("image")[i].as_buffer())
            ids = image.ids(0, image.n_ids).astype("<u4").tobytes()
            starts = image.starts.astype(np.int64)
            crc = [zlib.crc32(ids[4 * s:4 * e]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(crc), b.column("part")[i].as_py(), np.int32)),
                 pa.array(image.docs, mask=image.known == 0), pa.array(starts[:-1] + b.column("part_start")[i].as_py()),
                 pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(images: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the images alone."""
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per partition written
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = images.select("part", "part_start", "image").mapInArrow(
        _documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(write_token_ids(docs))
