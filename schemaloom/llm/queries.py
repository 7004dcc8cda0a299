"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import ann, html_text, langid, mixing, order_minhash, packing, simhash, substring_dedup, token_counts, warc

QUERIES: dict[str, Callable] = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_nearest_neighbours": ann.op2,
    "op3_order_minhash": order_minhash.op3,
    "op4_curriculum_mix": mixing.op4,
    "op5_html_text": html_text.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_simhash_dedup": simhash.op7,
    "op8_language_id": langid.op8,
    "op9_warc": warc.op9,
    "op10_token_counts": token_counts.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op4_curriculum_mix": mixing.OP4_SQL,
    "op9_warc": warc.OP9_SQL,
}
