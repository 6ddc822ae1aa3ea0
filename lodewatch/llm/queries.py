"""Queries of this subpackage and the SQL that they agree with."""

from __future__ import annotations

from . import audit, divergence, licenses, linededup, mixing, neardup, packing, quality, revisits, sharding, substrings, topk, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_setsketch_neardup": neardup.op2_setsketch_neardup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_revisit_resolution": revisits.op4_revisit_resolution,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_maxscore_top20": topk.op6_maxscore_top20,
    "op7_hilbert_shards": sharding.op7_hilbert_shards,
    "op8_line_quality": quality.op8_line_quality,
    "op9_pack_sequences": packing.op9_pack_sequences,
    "op10_ftrl_toxicity": toxicity.op10_ftrl_toxicity,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_substring_dedup": substrings.op12_substring_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_revisit_resolution": revisits.OP4_SQL,
    "op6_maxscore_top20": topk.OP6_SQL,
    "op8_line_quality": quality.OP8_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_substring_dedup": substrings.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
