"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; they
are the seed entities and always stay.  Other strings of a plausible shape (an
address without a dot or with a bracketed "at", a number without a plus, a
15-digit card, IPv6) are candidates.  The two or three tokens before and the two
behind a mention are its lexical patterns.

Mentions form a graph of patterns and instances (normalised identifiers), kept
as a table of edges.  Spark scores it in turns until no instance is added:

* a pattern's confidence for a kind is the weight of the accepted instances'
  mentions beside it over all places of the corpus where its tokens stand,
  whatever follows them; it also needs several different accepted instances;
* a candidate's score is the noisy-or of its confident patterns, and one above
  the threshold is accepted with all its mentions.

Only patterns with enough different instances are counted over the corpus.
They are told from other token sequences by a bitmap of fixed size (2**25
bits), whose false positives the join with the patterns removes.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import TwoGenerations, id_and_text, slices, written

KINDS = ("email", "ip", "card", "phone")

#: Different accepted instances that a pattern needs, its least confidence, a candidate's least score.
MIN_INSTANCES, MIN_CONFIDENCE, MIN_SCORE = 3, 0.3, 0.5
#: Places that every pattern is taken to have had besides, so that a few mentions prove little.
PRIOR = 2
BITMAP_BITS = 25

# ---------------------------------------------------------------------------
# base spans: the contract's patterns, written so that long runs take time in proportion
# ---------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > past and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            past = m.end()
        at = text.find("@", max(past, at + 1))
    return out


def _small_parts(found: str, cut: str = ".") -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split(cut))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kind and start; code points, end exclusive."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _small_parts(m[0])]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


# ---------------------------------------------------------------------------
# candidates: other shapes of the same kinds
# ---------------------------------------------------------------------------
_BEFORE_AT = re.compile(r"[^\s@<>()\[\]{},;:\"']{1,64}\Z")
_BEHIND_AT = re.compile(r"[^\s@<>()\[\]{},;:\"']{1,255}(?<![.!?])")
_BRACKETED = re.compile(r" ?[\[({] ?at ?[\])}] ?", re.I)
_BEFORE_BRACKET = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_DOTTED = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]+)+", re.I)
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{4,39}(?![0-9A-Za-z:])")
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])")
_ANY_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,}+(?![0-9])")
_ANY_PHONE = re.compile(r"(?<![0-9+])\(?[0-9][0-9\x20()./-]{4,}[0-9]")


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Plausible spans that no base span touches, without overlaps inside a kind."""
    found = []
    at = text.find("@")
    while at >= 0:
        a, b = _BEFORE_AT.search(text, max(0, at - 64), at), _BEHIND_AT.match(text, at + 1)
        if a and b:
            found.append((0, a.start(), b.end()))
        at = text.find("@", at + 1)
    for m in _BRACKETED.finditer(text):
        a, b = _BEFORE_BRACKET.search(text, max(0, m.start() - 64), m.start()), _DOTTED.match(text, m.end())
        if a and b:
            found.append((0, a.start(), b.end()))
    for m in _IP6.finditer(text):
        if m[0].count(":") >= 2:
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            found.append((1, m.start(), m.end()))
    found += [(1, m.start(), m.end()) for m in _DEFANGED.finditer(text)
              if all(int(p) <= 255 for p in re.findall("[0-9]+", m[0]))]
    for m in _ANY_CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in _ANY_PHONE.finditer(text) if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    if not found:
        return []
    busy = sorted((s, e) for _, s, e in taken)
    starts, ends = [s for s, _ in busy], [0, *accumulate((e for _, e in busy), max)]
    out, last = [], {}
    for k, s, e in sorted(set(found)):
        # of the base spans that start before this one's end, the furthest end
        if ends[bisect_left(starts, e)] <= s and last.get(k, -1) <= s:
            last[k] = e
            out.append((k, s, e))
    return out


def instance(kind: int, found: str) -> str:
    """The identifier that a mention names, however it is written."""
    return re.sub(r"\s", "", found.lower()) if kind < 2 else _NOT_DIGIT.sub("", found)


# ---------------------------------------------------------------------------
# lexical patterns
# ---------------------------------------------------------------------------
_TOKEN = re.compile(r"\w{1,64}|[^\w\s]")
_WINDOW = 400
_MUL, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str) -> list[str]:
    """Lower-cased words and marks; a number is one token, whatever its digits."""
    return ["0" if t.isdigit() else t for t in _TOKEN.findall(text.lower())]


def token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode())


def _mixed(parts: list[np.ndarray], tag: int) -> np.ndarray:
    h = np.full(len(parts[0]), tag, np.uint64)
    for p in parts:
        h = (h ^ p) * _MUL
        h ^= h >> np.uint64(29)
    h *= _END
    return (h ^ (h >> np.uint64(32))).view(np.int64)


#: Pattern name, tokens before (-) or behind the mention, nearest last or first.
TEMPLATES = (("before", 2), ("before", 3), ("behind", 2))


def sequence_codes(hashes: np.ndarray) -> dict[tuple[str, int], np.ndarray]:
    """The code of every token sequence of a text, for each template."""
    out = {}
    for tag, (side, n) in enumerate(TEMPLATES):
        m = len(hashes) - n + 1
        out[side, n] = _mixed([hashes[i:i + m] for i in range(n)], tag) if m > 0 else np.empty(0, np.int64)
    return out


def patterns(text: str, start: int, end: int) -> list[tuple[int, str]]:
    """(code, tokens) of the patterns that surround a span."""
    before, behind = tokens(text[max(0, start - _WINDOW):start]), tokens(text[end:end + _WINDOW])
    out = []
    for tag, (side, n) in enumerate(TEMPLATES):
        part = before[-n:] if side == "before" else behind[:n]
        if len(part) == n:
            hashes = [np.array([token_hash(t)], np.uint64) for t in part]
            out.append((int(_mixed(hashes, tag)[0]), " ".join([*part, "_"] if side == "before" else ["_", *part])))
    return out


_FOUND = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, " \
         "spans array<struct<kind:int,start:int,end:int>>, " \
         "mentions array<struct<kind:int,start:int,end:int,instance:string,seed:boolean,patterns:array<struct<code:long,pattern:string>>>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([*_SPAN, ("instance", pa.string()), ("seed", pa.bool_()),
                      ("patterns", pa.list_(pa.struct([("code", pa.int64()), ("pattern", pa.string())])))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS],
                        ("base_sha256", pa.string()), ("spans", pa.list_(_SPAN)), ("mentions", pa.list_(_MENTION))])
    row = TaskContext.get().partitionId() << 33
    for b in slices(batches):
        out = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            spans = base_spans(text)
            counts = [0] * len(KINDS)
            for k, *_ in spans:
                counts[k] += 1
            mentions = []
            for seed, found in ((True, spans), (False, candidates(text, spans))):
                for k, s, e in found:
                    mentions.append({"kind": k, "start": s, "end": e, "instance": instance(k, text[s:e]), "seed": seed,
                                     "patterns": [{"code": c, "pattern": p} for c, p in patterns(text, s, e)]})
            out.append({"row": row, "doc_id": doc_id, **{f"n_{k}": n for k, n in zip(KINDS, counts)},
                        "base_sha256": hashlib.sha256(joined(spans).encode()).hexdigest(),
                        "spans": [{"kind": k, "start": s, "end": e} for k, s, e in spans], "mentions": mentions})
            row += 1
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _counted(bits: bytes):
    """Places of the sequences that the bitmap knows, summed over a slice of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits, np.uint8)
        cache = TwoGenerations(200_000)
        for b in slices(batches):
            met = []
            for text in b.column("text").to_pylist():
                own = tokens(text)
                cache.begin()
                for t in cache.missing(set(own)):
                    cache[t] = token_hash(t)
                hashes = np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))
                for codes in sequence_codes(hashes).values():
                    at = codes & ((1 << BITMAP_BITS) - 1)
                    met.append(codes[(known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1])
            codes, n = np.unique(np.concatenate(met), return_counts=True) if met else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "places"])
    return run


def _bitmap(codes: DataFrame) -> bytes:
    """The codes' low bits as a bitmap: at most 2**BITMAP_BITS bits reach the driver."""
    at = F.col("code").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1
    rows = codes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = bytearray(1 << (BITMAP_BITS - 3))
    for r in rows:
        first = (r["bucket"] - 1) * 4096
        out[first:first + 4096] = r["bits"]
    return bytes(out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of base spans and mentions, a row per input row."""
    return written(id_and_text(docs, id_col, text_col).mapInArrow(_find, _FOUND), "mentions")


def score_graph(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_instances: int = MIN_INSTANCES, min_confidence: float = MIN_CONFIDENCE,
                min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(accepted, confident patterns): ``kind, instance, score`` of seeds and of the candidates that
    were accepted, and ``kind, code, pattern, confidence``."""
    mentions = found.select(F.inline("mentions"))
    # an edge per pattern and instance, with its number of mentions: these sums combine map-side
    edges = written(mentions.select("kind", "instance", F.inline("patterns")).groupBy("kind", "code", "instance").agg(
        F.count(F.lit(1)).alias("n"), F.min("pattern").alias("pattern")), "edges")
    wide = edges.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= min_instances)
    asked = written(wide.select("kind", "code"), "asked")
    places = id_and_text(docs, id_col, text_col).select("text").mapInArrow(_counted(_bitmap(asked.select("code").distinct())), "code long, places long") \
        .groupBy("code").agg(F.sum("places").alias("places"))
    graph = written(edges.join(asked.join(places, "code", "left").select("kind", "code", F.coalesce("places", F.lit(0)).alias("places")),
                               ["kind", "code"]), "graph")
    accepted = written(mentions.where("seed").select("kind", "instance").distinct().withColumn("score", F.lit(1.0)), "accepted")
    n = accepted.count()
    while True:
        scored = graph.join(accepted, ["kind", "instance"]).groupBy("kind", "code").agg(
            F.count(F.lit(1)).alias("instances"), F.sum(F.col("n") * F.col("score")).alias("weight"),
            F.max("places").alias("places"), F.min("pattern").alias("pattern"))
        # a mention's own place counts even where its text was cut otherwise
        confidence = F.col("weight") / (F.greatest("places", "weight") + PRIOR)
        good = written(scored.where(F.col("instances") >= min_instances).select("kind", "code", "pattern", confidence.alias("confidence"))
                       .where(F.col("confidence") >= min_confidence), "patterns")
        found_by = graph.join(good.drop("pattern"), ["kind", "code"]).join(accepted, ["kind", "instance"], "left_anti") \
            .groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        accepted = written(accepted.unionByName(found_by.where(F.col("score") >= min_score)), "accepted")
        before, n = n, accepted.count()
        if n == before:
            return accepted, good


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans),
    ``base_sha256``, ``spans`` (all spans as ``kind:start:end``) and ``n_added``.

    Null and empty texts hold nothing: zeros, the empty string's hash, no spans.  Repeated rows and
    rows without an id each have a row, and their mentions count; an empty table gives none.  Other
    columns play no part, whatever their names.  Texts are read whole, however long.
    """
    found = find(docs, id_col, text_col)
    accepted, _ = score_graph(found, docs, id_col, text_col, **limits)
    new = found.select("row", F.inline("mentions")).where("not seed").select("row", "kind", "start", "end", "instance") \
        .join(accepted.select("kind", "instance"), ["kind", "instance"], "left_semi") \
        .groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))  # of one text
    names = F.array(*[F.lit(k) for k in KINDS])
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    every = F.array_sort(F.concat("spans", F.coalesce("added", none)))
    said = F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    return found.drop("mentions").join(new, "row", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(said, ",").alias("spans"),
        F.size(F.coalesce("added", none)).cast("long").alias("n_added"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return personal_data(docs)
