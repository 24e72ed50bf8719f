"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from . import exactdups, lines, mixing, neardups, prefixes, quality, repeats, secrets, segmentation, sharding, spelling, tokens, vectors

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_line_dedup": lines.query,
    "op3_token_output": tokens.query,
    "op4_exact_dedup": exactdups.query,
    "op5_topk_search": vectors.query,
    "op6_secret_scan": secrets.query,
    "op7_source_mixing": mixing.query,
    "op8_near_dedup": neardups.query,
    "op9_kd_sharding": sharding.query,
    "op10_sampled_segmentation": segmentation.query,
    "op11_prefix_trie": prefixes.query,
    "op12_spelling_variants": spelling.query,
    "op13_substring_dedup": repeats.query,
}
ORACLES = {
    "op2_line_dedup": lines.ORACLE,
    "op4_exact_dedup": exactdups.ORACLE,
    "op5_topk_search": vectors.ORACLE,
    "op11_prefix_trie": prefixes.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_substring_dedup": repeats.ORACLE,
}
