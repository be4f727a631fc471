"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

The test items are the indexed side, and every passage of every training
document is a query.  Index terms are pairs of neighbouring words, so common
words alone make no match; in scripts without spaces each character is a word.  A posting's weight is its BM25 impact as a share
of the item's own full score: an item that a passage holds whole scores 1,
and one threshold means the same for short and long items.  All items at or
above it are retrieved; then the words of both are compared: those of the
question and those of the answer.  The share of the whole item's five-word
shingles is reported and decides nothing: one word put between question and
answer breaks four of them.

Items are indexed by length class (up to 16 words, up to 32 and so on by powers
of two).  A class's passages are windows of twice its length, begun every such
length, so an item that a document holds lies whole in one of them, and what an
item is compared with depends on the item alone, not on those indexed with it.
A window whose terms' upper bounds together stay below the threshold ends WAND
before its first pivot; these sums are taken for all windows of a task at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, TwoGenerations, chunks, enter, id_and_text, slices, written

K1, B = 1.2, 0.75
THRESHOLD = 0.6     # share of an item's own score
OVERLAP = 0.8       # of question words and of answer words
SHINGLE = 5
BLOCK = 16          # postings of a block of block-max WAND
INDEX_ITEMS = 20_000  # items of one index; more items make more indexes, each a pass over the documents
LEAST_CLASS = 16    # words of the first length class

NONE, MANY = -2, -3  # no word, several words

#: Letters and marks of scripts that put no space between words: Thai, Lao, Tibetan, Myanmar,
#: Khmer, Tai, Javanese, Balinese, kana, bopomofo, Yi and Han.
_UNSPACED = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u0f00\u0f35\u0f37\u0f39\u0f40-\u0f84"
             "\u0f86-\u0fbc\u1000-\u103f\u1050-\u108f\u109a-\u109d\u1780-\u17d3\u17d7\u17dc\u17dd\u1950-\u19c9"
             "\u1a00-\u1a1b\u1a20-\u1a7c\u1aa7\u1b00-\u1b4c\ua980-\ua9c0\ua9cf\ua9e0-\ua9ef\ua9fa-\ua9fe\uaa60-\uaadf"
             "\u2e80-\u2fd5\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u303c\u3041-\u3096\u3099-\u309f\u30a1-\u30fa\u30fc-\u30ff"
             "\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c\uf900-\ufaff\uff66-\uff9f\U00016fe0-\U00018cff"
             "\U0001aff0-\U0001b2ff\U00020000-\U0003ffff")
_UNITS = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
_PIECES = re.compile(rf"[{_UNSPACED}][^\s\w{_UNSPACED}]*|[^\s{_UNSPACED}]+")
_EDGES = re.compile(rf"^(?:(?![{_UNSPACED}])[\W_])+|(?:(?![{_UNSPACED}])[\W_])+$")
_SENTENCE = re.compile("[.?!\u3002\uff01\uff0e\uff1f\uff61]$")


def normal(word: str) -> str:
    return _EDGES.sub("", word.lower())


def words_of(text: str | None) -> list[str]:
    """The one way in which items and documents are cut: at any Unicode white space,
    and around each character of a script without spaces."""
    return [w for w in map(normal, _UNITS.findall(text or "")) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words up to and from the last sentence that begins in its second
    half; without one, its last quarter is the answer."""
    raw = _PIECES.findall(text or "")
    cut = next((i for i in range(len(raw) - 1, (len(raw) - 1) // 2, -1) if _SENTENCE.search(raw[i - 1])), len(raw) - max(1, len(raw) // 4))
    return words_of(" ".join(raw[:cut])), words_of(" ".join(raw[cut:]))


def shingles(words: list[int], n: int = SHINGLE) -> set[tuple[int, ...]]:
    """Distinct runs of ``n`` words; fewer words are one run."""
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def share(part: list[int], whole: Counter) -> float:
    """The share of ``part``'s words, repeated ones included, that ``whole`` has."""
    return sum(min(n, whole[w]) for w, n in Counter(part).items()) / len(part) if part else 1.0


def pairs(words: list) -> Counter:
    return Counter(zip(words, words[1:]))


class Statistics:
    """Of all items, however many indexes they are cut into: their number, the mean of
    their pairs, and in how many of them a pair stands (one, if it isn't in ``df``)."""

    def __init__(self, items: int, mean: float, df: dict[tuple[str, str], int]):
        self.items, self.mean, self.df = items, mean, df


def length_class(words: int) -> int:
    return max(LEAST_CLASS, 1 << (words - 1).bit_length())


class Postings:
    """The items of one length class: posting lists with their blocks, and the search."""

    def __init__(self, items: list[tuple[int, tuple[list[int], list[int]]]], bags: list[Counter], length: int,
                 number: dict[tuple[int, int], int], count: int, mean: float, df):
        self.ids, self.parts = [i for i, _ in items], [p for _, p in items]
        self.shingles = [shingles(q + a) for q, a in self.parts]
        self.length = length
        postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for d, bag in enumerate(bags):
            impact = {t: math.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1)
                      / (n + K1 * (1 - B + B * bag.total() / mean)) for t, n in bag.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((d, x / own))
        terms = sorted(postings)
        self.own = np.full(len(number), -1)  # of the index's terms, those of this class
        self.own[[number[t] for t in terms]] = np.arange(len(terms))
        self.lists = [([d for d, _ in postings[t]], [x for _, x in postings[t]]) for t in terms]
        self.upper = np.array([max(w) for _, w in self.lists])
        # per block of a list: its last item and its highest weight
        self.blocks = [[(d[min(i + BLOCK, len(d)) - 1], max(w[i:i + BLOCK])) for i in range(0, len(d), BLOCK)] for d, w in self.lists]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose score for the distinct ``terms`` reaches ``threshold``, by block-max WAND."""
        lists, blocks, upper = self.lists, self.blocks, self.upper
        end = len(self.ids)
        at = {t: 0 for t in terms}
        here = {t: lists[t][0][0] for t in terms}

        def advance(t, item):
            docs, i = lists[t][0], at[t]
            while i < len(docs) and docs[i] < item:
                # whole blocks that end before the item are passed over
                i = (i // BLOCK + 1) * BLOCK if blocks[t][i // BLOCK][0] < item else i + 1
            at[t], here[t] = i, docs[i] if i < len(docs) else end
        found = []
        slack = 1e-9
        while True:
            order = sorted(terms, key=here.__getitem__)
            total, pivot = 0.0, None
            for k, t in enumerate(order):
                if here[t] == end:
                    break
                total += upper[t]
                if total + slack >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = here[order[pivot]]
            while pivot + 1 < len(order) and here[order[pivot + 1]] == item:
                pivot += 1
            ahead = order[:pivot + 1]
            bound, until = 0.0, end
            for t in ahead:
                k = at[t] // BLOCK
                while k < len(blocks[t]) and blocks[t][k][0] < item:
                    k += 1
                if k < len(blocks[t]):
                    bound += blocks[t][k][1]
                    until = min(until, blocks[t][k][0] + 1)
            if bound + slack < threshold:
                # no item up to the first block's end can reach the threshold
                if pivot + 1 < len(order):
                    until = min(until, here[order[pivot + 1]])
                for t in ahead:
                    advance(t, max(until, item + 1))
            elif here[order[0]] == item:
                score = sum(lists[t][1][at[t]] for t in ahead)
                if score + slack >= threshold:
                    found.append((item, score))
                for t in ahead:
                    advance(t, item + 1)
            else:
                for t in ahead:
                    if here[t] < item:
                        advance(t, item)

    def windows(self, codes: np.ndarray, both: np.ndarray, term: np.ndarray, out: dict) -> None:
        """``both``: places of the pairs that are terms of the index, ``term``: which."""
        term = self.own[term]
        both, term = both[term >= 0], term[term >= 0]
        if not len(both):
            return
        bounds = np.concatenate([[0.0], np.cumsum(self.upper[term])])
        starts = np.arange(0, max(1, len(codes) - self.length), self.length)
        lo, hi = np.searchsorted(both, starts), np.searchsorted(both, starts + 2 * self.length - 1)
        for k in np.flatnonzero(bounds[hi] - bounds[lo] >= THRESHOLD - 1e-9).tolist():
            matches = self.search(sorted(set(term[lo[k]:hi[k]].tolist())), THRESHOLD)
            if matches:
                words = codes[starts[k]:starts[k] + 2 * self.length].tolist()
                grams, counts = {}, Counter(words)
                for d, score in matches:
                    q, a = self.parts[d]
                    mine = self.shingles[d]
                    n = len(next(iter(mine)))
                    if n not in grams:
                        grams[n] = shingles(words, n)
                    same = len(mine & grams[n]) / len(mine)
                    found = (score, same, share(q, counts), share(a, counts))
                    if min(found[2:]) >= OVERLAP and found > out.get(self.ids[d], ()):
                        out[self.ids[d]] = found


class Index:
    """Items by length class, with one vocabulary.  ``of_all`` has the statistics of all items
    where these are only some."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], of_all: Statistics | None = None):
        items = sorted((i, q, a) for i, q, a in items if len(q) + len(a) >= 2)
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary
        parts = [tuple([number.setdefault(x, len(number)) for x in part] for part in (q, a)) for _, q, a in items]
        bags = [pairs(q + a) for q, a in parts]
        df = Counter(t for bag in bags for t in bag)
        count, mean = len(bags), sum(map(Counter.total, bags)) / max(1, len(bags))
        if of_all is not None:
            count, mean, df = of_all.items, of_all.mean, dict.fromkeys(df, 1)
            df.update({(number[a], number[b]): n for (a, b), n in of_all.df.items() if a in number and b in number})
        by: dict[int, list[int]] = defaultdict(list)
        for i, (q, a) in enumerate(parts):
            by[length_class(len(q) + len(a))].append(i)
        terms = sorted({t for bag in bags for t in bag})
        self.keys = np.array([a * len(number) + b for a, b in terms], np.int64)
        of = {t: i for i, t in enumerate(terms)}
        self.classes = [Postings([(items[i][0], parts[i]) for i in own], [bags[i] for i in own], length, of, count, mean, df)
                        for length, own in sorted(by.items())]

    @property
    def lists(self) -> list[tuple[list[int], list[float]]]:
        """All classes' posting lists in a row; items are numbered through the classes, too."""
        out, first = [], 0
        for c in self.classes:
            out += [([d + first for d in docs], weights) for docs, weights in c.lists]
            first += len(c.ids)
        return out

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items of all classes whose score for the distinct ``terms`` (numbers of ``lists``) reaches ``threshold``."""
        out, first, at = [], 0, 0
        for c in self.classes:
            own = [t - at for t in terms if at <= t < at + len(c.lists)]
            out += [(d + first, score) for d, score in c.search(own, threshold)]
            first, at = first + len(c.ids), at + len(c.lists)
        return out

    def codes(self, words: bytes) -> list[int]:
        """Numbers of the words; -1 for a word that no item has."""
        return [self.vocabulary.get(w, -1) for w in words_of(words.decode())]

    def encode(self, text: bytes, known: TwoGenerations) -> np.ndarray:
        """``codes`` of a text, which is cut at ASCII white space first: what stands
        between is looked up, and only where it is several words cut further."""
        raw = text.split()
        for w in known.missing(set(raw)):
            c = self.codes(w)
            known[w] = c[0] if len(c) == 1 else MANY if c else NONE
        out = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
        parts, start = [], 0
        for i in np.flatnonzero(out == MANY).tolist():
            parts += [out[start:i], np.array(self.codes(raw[i]), np.int64)]
            start = i + 1
        out = np.concatenate([*parts, out[start:]]) if parts else out
        return out[out != NONE]

    def leaks(self, text: bytes, known: TwoGenerations) -> dict[int, tuple[float, float, float, float]]:
        """Items that the text holds: best score, shingle, question and answer overlap."""
        out: dict[int, tuple] = {}
        if not self.classes:
            return out
        tails = [np.empty(0, np.int64)] * len(self.classes)
        for piece in chunks(text) if len(text) > SLICE_BYTES else [text]:
            here = self.encode(piece, known)  # one cut of the text for all classes
            met = self.pairs(here)
            for k, postings in enumerate(self.classes):
                codes = np.concatenate([tails[k], here]) if len(tails[k]) else here
                postings.windows(codes, *(self.pairs(codes) if len(tails[k]) else met), out)
                tails[k] = codes[-2 * postings.length:]
        return out

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the neighbouring words that are a term, and the terms."""
        both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        key = codes[both] * len(self.vocabulary) + codes[both + 1]
        term = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[term] == key
        return both[hit], term[hit]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct pairs, and a row without words that has the number of all its pairs."""
    for b in slices(batches):
        rows: list[tuple] = []
        for block, t in zip(b.column("block").to_pylist(), b.column("text").to_pylist()):
            bag = pairs([w for part in question_and_answer(t) for w in part])
            if bag:
                rows.append((block, None, None, bag.total()))
                rows += [(block, *t, 1) for t in bag]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["block", "a", "b", "n"])


def _statistics(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of the items that are looked for, the mean of their pairs, and by block of items
    how many items of all blocks have a pair, for the pairs of several; all counted by Spark."""
    found = written(items.select(F.col("block").cast("long").alias("block"), F.coalesce("text", F.lit("")).alias("text"))
                    .mapInArrow(_pairs, "block long, a string, b string, n long"), "item-pairs")
    n = found.where("a is null").agg(F.count(F.lit(1)), F.avg("n")).first()
    per_block = found.where("a is not null").groupBy("block", "a", "b").agg(F.sum("n").alias("n"))
    several = per_block.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
    return n[0], n[1] or 0.0, written(per_block.select("block", "a", "b").join(several, ["a", "b"]), "item-pair-counts")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, shingle_overlap, question_overlap, answer_overlap``:
    one row for each item that a document's whole text holds.

    Null and empty texts hold nothing; items of one word (or one character of a
    script without spaces) are not looked for; items repeated with one id are one item for each text.  Rows
    repeated each have their rows; other columns play no part.  No items, or no documents: no rows.
    """
    spark = docs.sparkSession
    items = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    base = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, score double, shingle_overlap double, question_overlap double, answer_overlap double"
    passes = max(1, -(-items.count() // INDEX_ITEMS))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    shared = _statistics(numbered) if passes > 1 else None
    out = None
    for k in range(passes):
        # an index block is collected and broadcast: INDEX_ITEMS items in the mean, however many there are;
        # no result depends on which items share a block
        block = [(r["item_id"], *question_and_answer(r["text"])) for r in numbered.where(F.col("block") == k).select("item_id", "text").collect()]
        of_all = None
        if shared:
            count, mean, df = shared
            of_all = Statistics(count, mean, {(r["a"], r["b"]): r["n"] for r in df.where(F.col("block") == k).collect()})
        held = spark.sparkContext.broadcast(Index(block, of_all))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            enter("decontaminate")
            index, known = held.value, TwoGenerations(400_000)
            for b in slices(batches):
                known.begin()
                rows = []
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                    rows += [(d, i, *x) for i, x in sorted(index.leaks(t, known).items())]
                cols = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]],
                    names=["doc_id", "item_id", "score", "shingle_overlap", "question_overlap", "answer_overlap"])
        part = base.mapInArrow(run, schema)
        if passes > 1:  # a pass is written before the next index is made, and its own goes
            part = written(part, "leaks-found")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, items)
