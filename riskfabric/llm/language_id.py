"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text recognises every
substring of it.  A text is cut greedily into the longest phrases that occur
in a language's text (a symbol that doesn't occur is a phrase); the fewer
phrases it needs, the closer the text is to that language.  Phrases are
normalised to bits per symbol, ``phrases * log2(reference length) / length``,
because references may differ in length.

The automata are made into one table of (state, symbol) -> state, flagged
where a phrase ends, so a task steps through thousands of text segments at
once with numpy.  Texts are parsed whole, in segments of ``SEGMENT`` symbols;
a phrase also ends with its segment, the same for every language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import enter, id_and_text, slices

SEGMENT = 256
PART = 1 << 20  # characters of a long text that are worked on at once
ENDS = np.int32(1 << 30)

#: Symbols: 0 is anything but a letter (runs count once), 1 a letter that no reference has.
OTHER = 1


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, built one symbol at a time; state 0 is the start."""
    trans, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class Model:
    """``classes``: symbol of every code point; ``tables``: per language the flat
    transition table, whose entries are the next row's offset, plus ENDS where
    the symbol begins a phrase; the last symbol is padding and changes nothing."""

    def __init__(self, references: dict[str, str]):
        # text without a letter teaches no language
        references = {k: t for k, t in references.items() if any(c.isalpha() for c in t)}
        self.languages = sorted(references)
        letters = sorted({c for t in references.values() for x in t.lower() for c in x if c.isalpha()})
        symbol = {c: i + 2 for i, c in enumerate(letters)}
        self.width = len(letters) + 3
        kind = np.uint8 if self.width <= 256 else np.uint32
        self.classes = np.zeros(0x110000, kind)
        for code in range(0x110000):
            c = chr(code)
            if unicodedata.category(c)[0] == "L":
                self.classes[code] = symbol.get(c.lower(), OTHER)
        self.tables, self.bits = [], []
        for name in self.languages:
            syms = self.symbols([references[name]])[0].tolist()
            self.bits.append(float(np.log2(max(2, len(syms)))))
            self.tables.append(self._table(suffix_automaton(syms)))

    def _table(self, trans: list[dict[int, int]]) -> np.ndarray:
        width = self.width
        table = np.empty((len(trans), width), np.int32)
        first = np.zeros(width, np.int32)
        for c, t in trans[0].items():
            first[c] = t * width
        table[:] = first + ENDS
        for s, edges in enumerate(trans):
            if s:  # at the start every symbol begins a phrase, and an unseen one leads back there
                for c, t in edges.items():
                    table[s, c] = t * width
            table[s, width - 1] = s * width
        return table.ravel()

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts in a row, and the number that each has."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.classes[codes]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        ends = np.cumsum(n)
        starts = (ends - n)[n > 0]
        keep[starts] = True
        kept = np.zeros(len(texts), np.int64)
        if len(starts):
            kept[n > 0] = np.add.reduceat(keep, starts)
        return s[keep], kept

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text and language the number of phrases; the texts' lengths in
        symbols; their letters, and those of them that no reference has."""
        s, n = self.symbols(texts)
        segments = -(-n // SEGMENT)
        of = np.repeat(np.arange(len(texts)), segments)
        first = np.cumsum(segments) - segments
        lanes = np.full(int(segments.sum()) * SEGMENT, self.width - 1, s.dtype)
        lanes[np.arange(len(s)) + np.repeat(first * SEGMENT - (np.cumsum(n) - n), n)] = s
        lanes = np.ascontiguousarray(lanes.reshape(-1, SEGMENT).T)
        out = np.zeros((len(texts), len(self.tables)))
        for k, table in enumerate(self.tables):
            state, ended = np.zeros(lanes.shape[1], np.int32), np.zeros(lanes.shape[1], np.int32)
            for column in lanes:
                state += column
                state = table[state]
                ended += state >> 30
                state &= ENDS - 1
            out[:, k] = np.bincount(of, ended, len(texts))
        letters = np.zeros((len(texts), 2))
        if len(s):
            which = np.repeat(np.arange(len(texts)), n)
            letters[:, 0] = np.bincount(which, s != 0, len(texts))
            letters[:, 1] = np.bincount(which, s == OTHER, len(texts))
        return out, n, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """``place``, but a text of which no reference has most letters is ``und`` with score 0."""
        lang, score, unknown = self.place(texts)
        return ([x if u <= 0.5 else "und" for x, u in zip(lang, unknown)], [s if u <= 0.5 else 0.0 for s, u in zip(score, unknown)])

    def place(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """For each text the best learned language (``und`` without a letter), a score, and the
        share of its letters that no reference has.  The score is the posterior that the bits
        per symbol give, as evidence of 64 symbols at most."""
        parts, of = [], []
        for i, t in enumerate(texts):
            for k in range(0, len(t or ""), PART):
                parts.append(t[k:k + PART])
                of.append(i)
        count, n, letters = np.zeros((len(texts), len(self.tables))), np.zeros(len(texts)), np.zeros((len(texts), 2))
        if parts:
            c, m, has = self.phrases(parts)
            np.add.at(count, of, c)
            np.add.at(n, of, m)
            np.add.at(letters, of, has)
        if not self.tables:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        bits = count * np.array(self.bits) / np.maximum(n, 1)[:, None]
        best = bits.argmin(axis=1)  # a tie goes to the first name in alphabetical order
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(n, 64)[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        placed = letters[:, 0] > 0
        return ([self.languages[b] if x else "und" for b, x in zip(best, placed)],
                [float(v) if x else 0.0 for v, x in zip(score, placed)], (letters[:, 1] / np.maximum(letters[:, 0], 1)).tolist())


def references(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", symbols: int = 32_000,
               total: int = 2_000_000, texts: int = 256, preferred: int = 4_000) -> dict[str, str]:
    """A bounded sample of labelled text per language: distinct texts in the order
    of their hash, those of up to ``preferred`` characters first, until there
    are ``symbols`` characters (or ``total`` over the number of languages)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)) \
        .select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    keys = rows.select("lang", "h", (F.length("text") > preferred).alias("long")).groupBy("lang", "h").agg(F.min("long").alias("long"))
    # two levels: a language that most rows have is first thinned in 32 places
    keys = keys.withColumn("r", F.row_number().over(W.partitionBy("lang", F.pmod("h", F.lit(32))).orderBy("long", "h"))).where(f"r <= {texts}")
    keys = keys.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("long", "h"))).where(f"r <= {texts}")
    picked = rows.join(F.broadcast(keys.select("lang", "h", "r")), ["lang", "h"]) \
        .groupBy("lang", "r").agg(F.first(F.substring("text", 1, symbols)).alias("text")).collect()
    by: dict[str, list] = {}
    for row in sorted(picked, key=lambda x: (x["lang"], x["r"])):
        by.setdefault(row["lang"], []).append(row["text"])
    each = min(symbols, total // max(1, len(by)))
    return {name: " ".join(t)[:each] for name, t in by.items()}


def train(labelled: DataFrame, **bounds) -> Model:
    """A model of the languages in ``labelled``; without labelled text it knows none and answers ``und``."""
    return Model(references(labelled, **bounds))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, unknown_letters`` for every row's whole text: the best learned
    language, and the share of letters that no reference has.  A null text and one without a
    letter are ``und`` with score 0.  Repeated rows each have a row; other columns play no part."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language_id")
        for b in slices(batches, size=1 << 20):
            lang, score, unknown = held.value.place(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unknown, pa.float64())],
                names=["doc_id", "lang_pred", "score", "unknown_letters"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, unknown_letters double")


def language_of(docs: DataFrame, model: Model):
    """A function of a text column that gives the language as a column, for filters on ``docs``;
    ``und`` also where no reference has most of a text's letters."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def lang(texts: pa.Array) -> pa.Array:
        enter("language_id")
        out: list[str] = []
        whole = pa.RecordBatch.from_arrays([pa.compute.fill_null(texts, "")], names=["text"])
        for b in slices([whole], size=1 << 20):
            out += held.value.predict(b.column("text").to_pylist())[0]
        return pa.array(out, pa.string())
    return lang


def fold(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "unknown_letters")
