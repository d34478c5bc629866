"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from tickloom.llm import chat_format, decontaminate, exact_dedup, line_dedup, mixing, secrets, simhash, substring_dedup, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup.op1_exact_dedup,
        secrets.op2_secret_scan,
        line_dedup.op3_line_dedup,
        toxicity.op4_toxicity,
        chat_format.op5_chat_format,
        decontaminate.op6_decontaminate,
        mixing.op7_mix_sources,
        simhash.op8_simhash,
        substring_dedup.op9_substring_dedup,
        token_counts.op10_token_counts,
    )
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_chat_format": chat_format.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
}
