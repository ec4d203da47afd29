"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quoin.llm import (
    chat_quotes,
    decontam,
    exact_dedup,
    fill_in_middle,
    html_extract,
    line_dedup,
    near_dup,
    packing,
    resampling,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_chat_quotes": chat_quotes.op2_chat_quotes,
    "op3_toxicity": toxicity.op3_toxicity,
    "op6_decontam": decontam.op6_decontam,
    "op4_packing": packing.op4_packing,
    "op5_sharding": sharding.op5_sharding,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op9_near_dup": near_dup.op9_near_dup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_resampling": resampling.op12_resampling,
    "op13_html_extraction": html_extract.op13_html_extraction,
}
ORACLE = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_chat_quotes": chat_quotes.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
}
