"""Exact duplicates by a heavy-hitter split.

Texts are equal when they are identical after all white space is deleted.  A
frequent-items sketch of the Misra-Gries family (``approx_top_k``: at most
``tracked`` counters, an item above total / tracked is never missed, nothing
below its error is reported) names the digests that may be frequent.  Their
winners are found by an aggregation that combines map-side, so they are exact
whatever the sketch said, and are broadcast: at most ``heavy`` rows, whatever
the input.  Rows of those digests never meet in a shuffle.  All other digests
are ordinary groups.  Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import WHITE, id_and_text, written


def without_white_space(text: Column) -> Column:
    # one replace() per character is a byte search; translate() and a regular expression cost more
    for ch in WHITE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                heavy: int = 512, tracked: int = 4096) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.

    Of equal texts the row with the most code points in its original text,
    then the smallest ``doc_id``, stays.  A null text counts as empty, and all
    texts of white space only are one group.  A null id loses every tie.  Rows
    repeated with the same id count each in ``group_size`` and exactly one of
    them is ``kept``.  An empty table gives an empty result.  Other columns of
    the input play no part, whatever their names.
    """
    base = id_and_text(docs, id_col, text_col)
    rows = written(base.select(
        "doc_id",
        F.sha2(without_white_space(F.col("text")).cast("binary"), 256).alias("digest"),
        F.char_length("text").alias("n_chars"),
        F.monotonically_increasing_id().alias("row_id")), "exact-dedup")

    best = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"),
                    F.col("doc_id").alias("c"), F.col("row_id").alias("d"))
    frequent = rows.select(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top")) \
        .select(F.explode("top").alias("x")).select(F.col("x.item").alias("digest"))
    winners = rows.join(F.broadcast(frequent), "digest", "left_semi") \
        .groupBy("digest").agg(F.min(best).alias("w"), F.count(F.lit(1)).alias("group_size"))
    winners = written(winners.select(
        "digest", F.col("w.c").alias("keep_id"), F.col("w.d").alias("keep_row"), "group_size"), "exact-winners")

    out = ["doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
           F.col("digest").alias("text_sha256"), "n_chars"]
    hot = rows.join(F.broadcast(winners), "digest").select(*out)
    group = W.partitionBy("digest")
    first = group.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"), "row_id")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti") \
        .withColumn("keep_id", F.first("doc_id").over(first)) \
        .withColumn("keep_row", F.first("row_id").over(first)) \
        .withColumn("group_size", F.count(F.lit(1)).over(group)).select(*out)
    return hot.unionByName(rest)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS h FROM d),
g AS (SELECT doc_id, n, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size FROM k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).drop("n_chars")
