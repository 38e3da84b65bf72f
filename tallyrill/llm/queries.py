"""The queries of this subpackage, and SQL for those that it can express."""

from . import decontaminate, exact_dedup, html_text, near_dedup, pieces, quality, repeats, secrets, token_files, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_files": token_files.op2_token_files,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_repeats": repeats.op5_repeats,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_text": html_text.op9_html_text,
    "op10_pieces": pieces.op10_pieces,
}

SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
}
