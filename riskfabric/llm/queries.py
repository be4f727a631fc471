"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools

from . import byte_bpe, conversation_repair, decontaminate, exact_dedup, language_id, line_dedup, lm_score, ngram_join, personal_data, quality, token_binary, token_counts, tokenizer_alignment
from ._common import ship_package


def _registered(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {name: _registered(fn) for name, fn in {
    "op1_byte_bpe": byte_bpe.query,
    "op2_language_id": language_id.query,
    "op3_token_counts": token_counts.query,
    "op4_lm_score": lm_score.query,
    "op5_quality": quality.query,
    "op6_decontaminate": decontaminate.query,
    "op7_ngram_join": ngram_join.query,
    "op8_token_binary": token_binary.query,
    "op9_line_dedup": line_dedup.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_personal_data": personal_data.query,
    "op13_tokenizer_alignment": tokenizer_alignment.query,
}.items()}

ORACLE_SQL = {
    "op9_line_dedup": line_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
