"""The thin queries over the given tables, and SQL where SQL can express them."""

from __future__ import annotations

from . import conversations, decontaminate, frames, html_text, jaccard, lines, packing, pii, quality, simhash, substrings, token_counts, whitening

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_lines": lines.op2_lines,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_pii": pii.op4_pii,
    "op5_quality": quality.op5_quality,
    "op6_packing": packing.op6_packing,
    "op7_substrings": substrings.op7_substrings,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_frames": frames.op10_frames,
    "op11_conversations": conversations.op11_conversations,
    "op12_similar_sets": jaccard.op12_similar_sets,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE: dict[str, str] = {
    "op2_lines": lines.OP2_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op7_substrings": substrings.OP7_SQL,
}
