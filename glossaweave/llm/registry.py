"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversation_repair, exact_dedup, fingerprint, grouped_packing, line_dedup, mixing, packing, quality, secret_scan, simhash, spelling, substring_dedup, token_store

QUERIES = {
    "op1_quality": quality.query,
    "op2_token_store": token_store.query,
    "op3_mixing": mixing.query,
    "op4_line_dedup": line_dedup.query,
    "op5_fingerprint": fingerprint.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_packing": packing.query,
    "op8_secret_scan": secret_scan.query,
    "op9_simhash": simhash.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_grouped_packing": grouped_packing.query,
    "op13_spelling": spelling.query,
}
ORACLE = {"op10_exact_dedup": exact_dedup.SQL, "op13_spelling": spelling.SQL}
