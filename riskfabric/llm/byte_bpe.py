"""Byte-level BPE as recursive DuckDB queries inside Spark tasks.

A task cuts its texts with the pre-tokenizer's pattern and hands every
distinct word it hasn't met to a recursive query.  A row of the recursion is a
word: its tokens and the ranks that the merge table gives its pairs.  A step takes each word's
lowest rank (the leftmost, on a tie), puts the merged token in and looks up
the two pairs that changed.  A word without a mergeable pair is done and leaves
the recursion with its ids.  An ordered aggregation decodes: ids join the vocabulary
and their bytes are listed by position.  Words and texts never leave their
task, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import re
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from ._common import SLICE_BYTES, TwoGenerations, held, id_and_text, slices, worker_mb

#: A step of the recursion rewrites all tokens of a word. Words of more bytes than this (long
#: unbroken runs) are contracted with a heap in the same order instead, which isn't quadratic.
LONG_WORD = 1000
#: Words of a text that are worked on at once; longer texts go in several rounds.
ROUND_WORDS = 1 << 19
#: Bytes of text whose words are held at once.
WORK_BYTES = SLICE_BYTES // 4
#: Words met whose ids a worker keeps, and as many of an older generation.
KEPT_WORDS = 100_000
#: Tokens of a query, at its start: all steps' rows of a recursive query are held until it ends.
QUERY_POSITIONS = 1 << 18
#: The rank of a pair that nothing merges.
NO_MERGE = (1 << 31) - 1

# Tokens stand between two marks (-1), which no pair merges with, so every pair has neighbours.
_ENCODE = f"""
WITH RECURSIVE step(word, toks, ranks, best) AS (
  SELECT word, toks, ranks, list_min(ranks) FROM start
  UNION ALL
  (WITH found AS (SELECT word, toks, ranks, best, list_position(ranks, best) AS p FROM step WHERE best < {NO_MERGE}),
   placed AS (SELECT word, toks[:p - 1] || [best] || toks[p + 2:] AS toks,
     ranks[:p - 2] || [coalesce(a.token, {NO_MERGE}), coalesce(b.token, {NO_MERGE})] || ranks[p + 2:] AS ranks
     FROM found LEFT JOIN merges a ON a.l = toks[p - 1] AND a.r = best LEFT JOIN merges b ON b.l = best AND b.r = toks[p + 2])
   SELECT word, toks, ranks, list_min(ranks) FROM placed)
)
SELECT word, toks AS ids FROM step WHERE best = {NO_MERGE} ORDER BY word
"""

_DECODE = """
SELECT doc, list(bytes ORDER BY pos) AS parts FROM tokens JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def word_patterns() -> tuple[str, str]:
    """The pre-tokenizer's pattern without the code points that only this engine counts as letters
    or numbers, and a pattern of these code points.  The two engines may know different versions
    of Unicode; texts that hold such code points need this slower pattern to be cut alike.  The
    driver finds them for all tasks."""
    odd = ""
    codes = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    pattern = public_tokenizers.PATTERN
    for name in (r"\p{L}", r"\p{N}"):
        engine = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(bytes(engine.encode_ordinary(codes)).decode())
        extra = [c for c in regex.findall(name, codes) if c not in theirs]
        ranges: list[list[int]] = []
        for c in map(ord, extra):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        if ranges:
            without = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
            pattern = pattern.replace(name, f"[{name}--[{without}]]")
            odd += without
    return pattern, f"[{odd}]" if odd else r"(?!)"


def ascii_pattern(pattern: str) -> str:
    """The pattern for texts of ASCII alone, in the classes of Python's own, faster engine."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


class Bpe:
    """The vocabulary's tables in an in-process DuckDB, and the words met so far."""

    def __init__(self, path: str, memory_mb: int = 400, patterns: tuple[str, str] | None = None):
        self.ranks = ranks = load_ranks(path)
        careful, odd = patterns or word_patterns()
        self.pattern, self.careful, self.odd = regex.compile(public_tokenizers.PATTERN), regex.compile(careful, regex.V1), re.compile(odd)
        self.plain = re.compile(ascii_pattern(public_tokenizers.PATTERN), re.ASCII)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pair = np.array([[ranks.get(bytes([i, j]), NO_MERGE) for j in range(256)] for i in range(256)], np.int32)
        left, right, token = [], [], []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    token.append(rank)
        self.db = duckdb.connect(config={
            "threads": 1, "memory_limit": f"{memory_mb}MB", "allocator_flush_threshold": "16MB",
            "temp_directory": tempfile.gettempdir()})  # what a task's queries spill, and only its own
        self._table("merges", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()),
                                        "token": pa.array(token, pa.int32())}))
        self._table("vocabulary", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()),
                                            "bytes": pa.array(list(ranks), pa.binary())}))
        width = len(str(max(ranks.values()))) + 1
        self.digits = np.zeros(max(ranks.values()) + 1, f"S{width}")
        for rank in ranks.values():
            self.digits[rank] = b"%d," % rank
        self.words = TwoGenerations(KEPT_WORDS)

    def _table(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words of two or more bytes each, by the recursive query."""
        if not words:
            return []
        n = np.fromiter(map(len, words), np.int64, len(words))
        cut = np.flatnonzero(np.diff(np.cumsum(n) // QUERY_POSITIONS)) + 1
        if len(cut):
            return [x for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(words)]) for x in self.contract(words[a:b])]
        ends = np.cumsum(n + 2)
        data, inside = np.zeros(ends[-1], np.uint8), np.ones(ends[-1], bool)
        inside[ends - 1] = inside[ends - n - 2] = False
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        tok = np.where(inside, self.byte[data], -1).astype(np.int32)
        rank = np.where(inside[:-1] & inside[1:], self.pair[data[:-1], data[1:]], NO_MERGE).astype(np.int32)
        at = np.concatenate([[0], ends]).astype(np.int32)
        self.db.register("start", pa.table({
            "word": np.arange(len(words), dtype=np.int32), "toks": pa.ListArray.from_arrays(at, tok),
            "ranks": pa.ListArray.from_arrays(at - np.arange(len(at), dtype=np.int32), np.delete(rank, ends[:-1] - 1))}))
        lists = self.db.sql(_ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("start")
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        return [flat[a + 1:b - 1] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def contract_long(self, word: bytes) -> np.ndarray:
        """The same contractions of one long word from a heap of (rank, position)."""
        ranks = self.ranks
        parts = [word[i:i + 1] for i in range(len(word))]
        prev, nxt = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = []

        def offer(i):
            if i >= 0 and nxt[i] >= 0 and (r := ranks.get(parts[i] + parts[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[nxt[i]]))
        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # the pair has changed since it was offered
            parts[i], parts[j], nxt[i] = a + b, None, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(prev[i])
            offer(i)
        return np.array([ranks[p] for p in parts if p is not None], np.int32)

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts that are given as lists of the pattern's matches."""
        self.words.begin()
        short, known, ranks = {}, self.words, self.ranks
        for w in known.missing(set().union(*texts)):
            b = w.encode()
            if (r := ranks.get(b)) is not None:  # a word of the vocabulary is that token
                known[w] = np.array([r], "<i4").tobytes()
            elif len(b) > LONG_WORD:
                known[w] = self.contract_long(b).tobytes()
            else:
                short[w] = b
        for w, ids in zip(short, self.contract(list(short.values()))):
            known[w] = ids.tobytes()
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, t)), "<i4") for t in texts]

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        """The bytes of lists of ids, by the ordered aggregation."""
        n = np.array([len(x) for x in docs], np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(n) // QUERY_POSITIONS)) + 1
        if len(cut):
            return [x for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(docs)]) for x in self.decode(docs[a:b])]
        out = [b""] * len(docs)
        if not n.sum():
            return out
        tok = np.concatenate(docs).astype(np.int32)
        self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(docs), dtype=np.int32), n),
                                             "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
        got = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("tokens")
        for chunk in got.to_batches():
            lists = chunk.column("parts")
            ends = np.frombuffer(lists.values.buffers()[1], np.int32)[lists.values.offset:]
            data = memoryview(lists.values.buffers()[2]) if lists.values.buffers()[2] else b""
            o = lists.offsets.to_numpy()
            for d, a, b in zip(chunk.column("doc").to_pylist(), ends[o[:-1]].tolist(), ends[o[1:]].tolist()):
                out[d] = bytes(data[a:b])
        return out

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids, each with a comma behind it."""
        cells = self.digits[ids].view(np.uint8)
        return cells[cells != 0].tobytes()

    def cut(self, text: str) -> re.Pattern | regex.Pattern:
        if text.isascii():
            return self.plain
        return self.careful if self.odd.search(text) else self.pattern

    def rounds(self, texts: list[str]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        """(documents, their ids): short texts together, a long one in several rounds."""
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
            found = (m[0] for m in self.cut(texts[0]).finditer(texts[0]))
            while part := list(itertools.islice(found, ROUND_WORDS)):
                yield [0], self.encode([part])
        else:
            yield list(range(len(texts))), self.encode([self.cut(t).findall(t) for t in texts])


def bpe(path: str, memory_mb: int = 400, patterns: tuple[str, str] | None = None) -> Bpe:
    return held("byte_bpe", (path, memory_mb), lambda: Bpe(path, memory_mb, patterns))


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row's whole text; null and empty texts have none."""
    path, mb = ranks or default_ranks(), worker_mb(docs.sparkSession)
    patterns = word_patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, mb, patterns)
        for b in slices(batches, size=WORK_BYTES):
            texts = b.column("text").to_pylist()
            got: list[list] = [[] for _ in texts]
            for who, ids in coder.rounds(texts):
                for d, x in zip(who, ids):
                    got[d].append(x)
            whole = [np.concatenate(x) if x else np.empty(0, np.int32) for x in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(whole, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``; an id outside the vocabulary raises."""
    path, mb = ranks or default_ranks(), worker_mb(encoded.sparkSession)
    patterns = word_patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, mb, patterns)
        top = max(coder.ranks.values())
        for b in batches:
            ids = [np.array(x if x is not None else [], np.int64) for x in b.column("ids").to_pylist()]
            if any(len(x) and (x.min() < 0 or x.max() > top) for x in ids):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(coder.decode(ids), pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests, one row
    per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.  Null counts
    as empty (no tokens); repeated rows each have a row; other columns play no part."""
    path, mb = ranks or default_ranks(), worker_mb(docs.sparkSession)
    patterns = word_patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, mb, patterns)
        for b in slices(batches, size=WORK_BYTES):
            texts = b.column("text").to_pylist()
            count = [0] * len(texts)
            of_ids, of_bytes = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for who, ids in coder.rounds(texts):
                for d, x, data in zip(who, ids, coder.decode(ids)):
                    if len(x):
                        decimal = coder.decimal(x)
                        of_ids[d].update(b"," + decimal[:-1] if count[d] else decimal[:-1])
                        count[d] += len(x)
                    of_bytes[d].update(data)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(count, pa.int64()), pa.array([h.hexdigest() for h in of_ids], pa.string()),
                 pa.array([h.hexdigest() for h in of_bytes], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs)
