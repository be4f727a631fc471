import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from riskfabric.llm import byte_bpe

from .test_dedup import brute_components, brute_lines
from .test_models import ITEMS, language_rows


def _tables(spark, tmp_path, edge_rows, labelled=True):
    rows = [(100 + i, t, k) for i, t, k in language_rows(40)] + [(d, t, None) for d, t in edge_rows]
    rows += [(300, f"some words before. {ITEMS[0][1]} and after", "aa"), (301, "words of\n" + ITEMS[1][1], "bb")]
    docs = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int").withColumn("row", F.lit("x"))
    if not labelled:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_every_stage_against_brute_force(shipped, tmp_path, edge_rows):
    sf = _tables(shipped, tmp_path, edge_rows)
    docs = shipped.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_join", "decontaminate", "byte_bpe"]

    def step(name, docs):
        out = stages[name](shipped, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        return shipped.read.parquet(path)
    one = step("language_id", docs)
    assert one.columns == columns
    assert _rows(one) == [x for x in _rows(docs) if any(c.isalpha() for c in x[1] or "")]

    two = step("line_dedup", one)
    assert two.columns == columns and all(r["n_chars"] == len(r["text"]) for r in two.collect())
    before, after = _rows(one), _rows(two)
    got = sorted((d, len(b.split("\n")), len(b.split("\n")) - (len(a.split("\n")) if a else 0), hashlib.sha256(a.encode()).hexdigest())
                 for (d, b), (_, a) in zip(before, after) if d is not None)
    want = [(d, n, n if h == hashlib.sha256(b"").hexdigest() else k, h) for d, n, k, h in brute_lines(before)]
    assert [(d, n, h) for d, n, _, h in got] == [(d, n, h) for d, n, _, h in want] and len(after) == len(before)

    three = step("ngram_join", two)
    parts = brute_components(_rows(two))
    kept = [d for d, _ in _rows(three)]
    assert three.columns == columns and sorted(d for d in kept if d is not None) == sorted(d for d, (_, c) in parts.items() if c == d)
    assert kept.count(None) == 1

    four = step("decontaminate", three)
    assert four.columns == columns and {d for d, _ in _rows(three)} - {d for d, _ in _rows(four)} == {300, 301}

    five = step("byte_bpe", four)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_ranks()), special_tokens={})
    want = sorted((str(d), len(ids), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in _rows(four) for ids in [enc.encode_ordinary(t or "")])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in five.collect()) == want
    assert sorted(map(str, corpus_pipeline.run(shipped, sf).collect())) == sorted(map(str, five.collect()))


def test_pipeline_of_nothing(shipped, tmp_path, edge_rows):
    sf = _tables(shipped, tmp_path, edge_rows, labelled=False)
    docs = shipped.read.parquet(f"{sf}/documents.parquet")
    # without labels there is nothing to learn from; texts with letters stay
    assert {r["doc_id"] for r in corpus_pipeline.languages(shipped, docs, sf).collect()} >= {4, 5, 15, 100}
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(shipped, empty, sf).count() == 0
