"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_text, langid, licenses, lm_score, near_dedup, pieces, token_file, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_file": token_file.op4_token_file,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_html_text": html_text.op6_html_text,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_language_id": langid.op8_language_id,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_license_scan": licenses.op10_license_scan,
}

#: DuckDB SQL where SQL can express the operator.
ORACLE = {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op5_decontaminate": decontaminate.ORACLE_SQL}
