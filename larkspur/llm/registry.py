"""Queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from larkspur.llm import audit, lines
from larkspur.llm.ann import op3_nearest
from larkspur.llm.bpe import op4_bpe
from larkspur.llm.fingerprints import op1_fingerprints
from larkspur.llm.html import op9_html_text
from larkspur.llm.language import op7_language
from larkspur.llm.negatives import ORACLE as NEGATIVES
from larkspur.llm.negatives import op12_hard_negatives
from larkspur.llm.near import op8_near_duplicates
from larkspur.llm.packing import op5_packing
from larkspur.llm.quality import op13_quality
from larkspur.llm.secrets import op2_secrets
from larkspur.llm.toxic import op10_toxicity

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_secrets": op2_secrets,
    "op3_nearest": op3_nearest,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_language": op7_language,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality": op13_quality,
}

#: DuckDB SQL; queries without an entry are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op6_line_dedup": lines.ORACLE, "op11_filter_audit": audit.ORACLE, "op12_hard_negatives": NEGATIVES}
