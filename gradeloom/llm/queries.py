"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from gradeloom.llm import (
    chat_format,
    classifier,
    collocations,
    conversation_repair,
    decontamination,
    html_extraction,
    line_dedup,
    lm_scoring,
    mixing,
    quality_rules,
    secrets,
    simhash,
    token_counts,
)

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        simhash.op2_simhash,
        classifier.op3_quality_classifier,
        html_extraction.op4_html_extraction,
        quality_rules.op5_quality_rules,
        line_dedup.op6_line_dedup,
        decontamination.op7_decontamination,
        lm_scoring.op8_lm_scoring,
        mixing.op9_mixing,
        chat_format.op10_chat_format,
        secrets.op11_secret_scans,
        conversation_repair.op12_conversation_repair,
        collocations.op13_collocations,
    )
}

ORACLES = {
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
