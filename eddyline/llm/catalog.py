"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from eddyline.llm import decontam, exact_dedup, html_extract, language_id, mixing, near_dedup, pii, secrets, token_counts, toxicity

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_pii": pii.op2_pii,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language_id": language_id.op6_language_id,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_html_text": html_extract.op10_html_text,
    "pii_base_spans": pii.pii_base_spans,
}
ORACLES = {
    "op1_mix": mixing.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op7_decontaminate": decontam.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "pii_base_spans": pii.BASE_ORACLE,
}
