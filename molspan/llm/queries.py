"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, html_text, language, line_dedup, minhash, mixing, packing, repetition, resharding, token_counts

QUERIES = {
    "op1_repetition": repetition.op1,
    "op2_token_counts": token_counts.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_packing": packing.op4,
    "op5_html_text": html_text.op5,
    "op6_resharding": resharding.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_mixing": mixing.op8,
    "op9_language": language.op9,
    "op10_minhash": minhash.op10,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
