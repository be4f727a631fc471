"""Token counts from an exact histogram of encoded lengths.

Documents are encoded and only their lengths go on.  One aggregation counts
the documents of each length; the histogram has a row per distinct length,
so everything after it is small beside the corpus.  Suffix sums over it
(documents that are longer, tokens that a limit keeps) answer totals,
quantiles and truncated totals for every context limit at once.  The sums
run in two levels, inside blocks of lengths and over the blocks, so no task
reads the whole histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import id_and_text, slices

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def rank_encoding(path: str) -> tiktoken.Encoding:
    """The tiktoken encoding of a rank file, loaded once per process."""
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every row, repeated ones too; null and empty texts have no tokens.
    Other columns play no part."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path)
        for b in slices(batches):
            n = [len(encoding.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def length_report(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """A row per distinct length L: ``n_tokens`` (L), ``n_docs`` (of that length),
    ``docs_at_most``, ``docs_longer``, ``tokens_at_most`` (all tokens of documents
    up to L), ``truncated_total`` (tokens left when every document is cut to L),
    ``total_tokens``, ``total_docs`` and ``share_at_most`` (of the documents: L is
    the q-quantile for the first share that reaches q).  No documents, no rows."""
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / block)) \
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)  # a row per 1,024 tokens of the longest text
    whole = W.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
                           F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
                           F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    r = h.join(blocks, "block") \
        .withColumn("docs_from", F.col("d_above") + F.sum("n_docs").over(inside)) \
        .withColumn("tokens_from", F.col("t_above") + F.sum("tokens").over(inside))
    longer = F.col("docs_from") - F.col("n_docs")
    at_most = F.col("total_tokens") - F.col("tokens_from") + F.col("tokens")
    docs_at_most = F.col("total_docs") - longer
    return r.select("n_tokens", "n_docs", docs_at_most.alias("docs_at_most"), longer.alias("docs_longer"),
                    at_most.alias("tokens_at_most"), (at_most + F.col("n_tokens") * longer).alias("truncated_total"),
                    "total_tokens", "total_docs", (docs_at_most / F.col("total_docs")).alias("share_at_most"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, truncated_total, docs_longer`` for any limits, present as lengths or not."""
    kept = [F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(m)) * F.col("n_docs")), F.lit(0)) for m in limits]
    longer = [F.coalesce(F.sum(F.when(F.col("n_tokens") > m, F.col("n_docs"))), F.lit(0)) for m in limits]
    rows = F.array(*[F.struct(F.lit(m).cast("long").alias("context_limit"), k.cast("long").alias("truncated_total"),
                              n.cast("long").alias("docs_longer")) for m, k, n in zip(limits, kept, longer)])
    return histogram.agg(rows.alias("r")).select(F.inline("r"))


def length_quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least ``share`` of the documents don't exceed."""
    first = [F.min(F.when(F.col("docs_at_most") >= F.ceil(F.lit(q) * F.col("total_docs")), F.col("n_tokens"))) for q in shares]
    rows = F.array(*[F.struct(F.lit(float(q)).alias("share"), x.alias("n_tokens")) for q, x in zip(shares, first)])
    return report.agg(rows.alias("r")).select(F.inline("r"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return length_report(length_histogram(encoded_lengths(docs)))
