"""A training-text pipeline: language, lines, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns that they were given.  Null texts count as empty; an empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.llm import byte_bpe, decontaminate, language_id, line_dedup, ngram_join
from riskfabric.llm._common import packed, ship_package, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on; those without a letter (null and empty ones, too) and
    those of which no labelled language has most letters go."""
    ship_package(spark)
    model = language_id.train(docs.where(F.col("lang").isNotNull()).select("text", "lang"))
    if not model.languages:  # nothing to learn from: only what no model could place goes
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang = language_id.language_of(docs, model)
    return docs.where(lang(F.col("text")) != "und")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that other documents keep; every document stays, and
    ``n_chars`` follows the text."""
    ship_package(spark)
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of rows
    repeated with one id, one.  Rows without an id, and texts without words, stay."""
    ship_package(spark)
    found = ngram_join.near_duplicate_components(docs)
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    rows = packed(docs).withColumn("doc_id", F.col("doc.doc_id")).withColumn("row", F.monotonically_increasing_id())
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("row")).join(stay, "doc_id", "left_semi")
    return rows.join(first.select("row", F.lit(True).alias("first")), "row", "left") \
        .where("doc_id is null or first").select("doc.*")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = written(decontaminate.contaminated(docs, items).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    ship_package(spark)
    return byte_bpe.round_trip(docs)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontaminate", leaks),
    ("byte_bpe", token_ids),
]

#: SQL expresses neither the language model nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
