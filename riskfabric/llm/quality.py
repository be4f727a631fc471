"""Document quality by hierarchical empirical Bayes.

A logistic classifier over surface statistics of the whole text gives each
document its own evidence.  Grouped aggregations sum the evidence (a training
label where there is one, else the classifier's probability) by path and by
host.  Their posteriors are Beta means whose prior strengths come from the
data: the variance between hosts, and between the paths of a host, beyond what
documents vary inside them.  A host of few documents shrinks to the global
mean, a path of few documents to its host's.  A document's log odds are those
of its text plus what its path, without itself, says beyond the global mean.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_of, written
from .language_id import fold

TRAIN_ROWS = 20_000  # labelled documents that the classifier is fitted on, at most
RIDGE = 1e-3
_MARKS = re.compile(r"[^\w\s]")
_DIGITS = re.compile(r"\d")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTERS = re.compile(r"[^\W\d_]")


def features(text: str) -> list[float]:
    """Surface statistics of a whole text; all 0 for a text without a word."""
    words = text.split()
    if not words:
        return [0.0] * 14
    n, chars = len(words), len(text)
    count = Counter(words)
    marks, letters = len(_MARKS.findall(text)), max(1, len(_LETTERS.findall(text)))
    lines = text.split("\n")
    odd = sum(1 for w in words if w[-1] in "#$%&*!|")
    return [
        1.0, math.log(n), sum(map(len, words)) / n / 10, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(count) / n, max(count.values()) / n, marks / chars, len(_DIGITS.findall(text)) / chars,
        len(_UPPER.findall(text)) / letters, odd / n, count["|"] / n, math.log(len(lines)),
        1 - len(set(lines)) / len(lines), text.count(".") / n]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"), b.column("host"), b.column("path"), pa.array(rows, pa.list_(pa.float64()))],
            names=["row", "doc_id", "host", "path", "x"])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regression by Newton's method on standardised features
    and their squares; (weights, means, scales).  With one class, or no rows, the
    weights give the smoothed share for every text."""
    both = np.hstack([x, x[:, 1:] ** 2]) if len(x) else np.zeros((0, 27))
    mean, scale = (both.mean(axis=0), both.std(axis=0)) if len(x) else (np.zeros(27), np.ones(27))
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    w = np.zeros(both.shape[1])
    share = (y.sum() + 1) / (len(y) + 2)
    w[0] = math.log(share / (1 - share))
    if len(y) and 0 < y.sum() < len(y):
        z = (both - mean) / scale
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            ridge = np.full(len(w), RIDGE * len(y))
            ridge[0] = 0
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6), z.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
    return w, mean, scale


def _evidence(model):
    w, mean, scale = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("x").to_pylist())
            z = (np.hstack([x, x[:, 1:] ** 2]) - mean) / scale
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row", "doc_id", "host", "path", "label", "train")] + [pa.array(p)],
                                             names=["row", "doc_id", "host", "path", "label", "train", "p_text"])
    return run


def _strength(groups: DataFrame, parent: list[str], total_sq: float) -> float:
    """Prior strength (in documents) of groups n, s below their parents, from the variance
    between groups that is left when the variance inside them is taken off."""
    up = groups.groupBy(*parent).agg(F.sum("n").alias("pn"), F.sum("s").alias("ps"), F.sum(F.col("n") * F.col("n")).alias("pnn"),
                                     F.sum(F.col("s") * F.col("s") / F.col("n")).alias("pss"), F.count(F.lit(1)).alias("k"))
    r = up.agg(F.sum("pn").alias("n"), F.sum("ps").alias("s"), F.sum("pss").alias("ss"), F.sum(F.col("ps") * F.col("ps") / F.col("pn")).alias("parents"),
               F.sum("k").alias("k"), F.count(F.lit(1)).alias("u"), F.sum(F.col("pn") - F.col("pnn") / F.col("pn")).alias("eff")).first()
    if not r["n"] or not r["eff"] or r["k"] <= r["u"] or r["n"] <= r["k"]:
        return 1e9
    inside = max(0.0, (total_sq - r["ss"]) / (r["n"] - r["k"]))
    between = (r["ss"] - r["parents"] - (r["k"] - r["u"]) * inside) / r["eff"]
    mean = r["s"] / r["n"]
    return min(1e9, max(0.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e9


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality") -> DataFrame:
    """One row per input row: ``doc_id, held_out, quality, good, p_text, path_quality, host_quality``.

    ``labels`` has ``doc_id`` and a 0/1 label; those of documents whose
    crc32(doc_id as text) mod 5 is 1 are held out.  Several labels of one
    document count by their majority, 1 on a tie; null ids and labels are
    ignored.  A null host or path is a site of its own.  A null or empty text
    has all statistics 0.  Without labels every text has probability 0.5.
    Repeated rows each have a row and each count for their site.  Other columns play no part.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), text_of(text_col).alias("text"))
    seen = written(base.mapInArrow(_features, "row long, doc_id long, host string, path string, x array<double>"), "quality-features")
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")) \
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    seen = written(seen.join(given, "doc_id", "left").withColumn("train", F.col("label").isNotNull() & ~held_out), "quality-rows")
    sample = seen.where("train").select("x", "label", F.xxhash64("doc_id").alias("h"), "row").orderBy("h", "row").limit(TRAIN_ROWS).collect()
    model = fit(np.array([r["x"] for r in sample]).reshape(len(sample), 14), np.array([r["label"] for r in sample], float))

    e = F.when(F.col("train"), F.col("label").cast("double")).otherwise(F.col("p_text"))
    rows = written(seen.mapInArrow(_evidence(model), "row long, doc_id long, host string, path string, label int, train boolean, p_text double")
                   .withColumn("e", e), "quality-evidence")
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"))
    paths = written(paths, "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not total["n"]:
        mean, by_host, by_path = 0.5, 1e9, 1e9
    else:
        mean = min(1 - 1e-6, max(1e-6, total["s"] / total["n"]))
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        by_host = _strength(hosts.withColumn("all", F.lit(1)), ["all"], total["q"])
        by_path = _strength(paths, ["host"], total["q"])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    sites = paths.join(hosts, "host")

    def posterior(s, n, prior, strength):
        return (s + prior * F.lit(strength)) / (n + F.lit(strength))
    edge = F.lit(1e-6)

    def logit(p):
        p = F.greatest(edge, F.least(1 - edge, p))
        return F.log(p / (1 - p))
    r = rows.join(sites, ["host", "path"])
    host_mean = posterior(F.col("hs") - F.col("e"), F.col("hn") - 1, F.lit(mean), by_host + 1e-9)
    path_mean = posterior(F.col("s") - F.col("e"), F.col("n") - 1, host_mean, by_path + 1e-9)
    odds = logit(F.col("p_text")) + logit(path_mean) - logit(F.lit(mean))
    return r.select("doc_id", held_out.alias("held_out"), (1 / (1 + F.exp(-odds))).alias("quality"), (odds >= 0).alias("good"),
                    "p_text", path_mean.alias("path_quality"), host_mean.alias("host_quality"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality(docs, labels)
