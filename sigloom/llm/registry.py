"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, langid, lmscore, middles, negatives, neighbours, packing, pii, shards, simhash, substrings, templates, vecdedup

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_pii": pii.op2_pii,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_html": templates.op4_html,
    "op5_packing": packing.op5_packing,
    "op6_language_id": langid.op6_language_id,
    "op7_bpe": bpe.op7_bpe,
    "op8_lm_score": lmscore.op8_lm_score,
    "op9_simhash": simhash.op9_simhash,
    "op10_vector_dedup": vecdedup.op10_vector_dedup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_fill_in_middle": middles.op12_fill_in_middle,
    "op13_sharding": shards.op13_sharding,
}
SQL: dict[str, str] = {
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_fill_in_middle": middles.OP12_SQL,
    "op13_sharding": shards.OP13_SQL,
}
