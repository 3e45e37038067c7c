"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import embed, langid, lmscore, minhash, mix, packing, quality, shard, toxicity, warc

QUERIES = {
    "op1_warc_bundles": warc.op1,
    "op4_language_id": langid.op4,
    "op2_toxicity": toxicity.op2,
    "op3_best_fit_packing": packing.op3,
    "op5_elias_fano_lm": lmscore.op5,
    "op6_bag_minhash": minhash.op6,
    "op7_mix_sources": mix.op7,
    "op8_cross_polytope": embed.op8,
    "op9_kd_shards": shard.op9,
    "op10_quality_rules": quality.op10,
}
ORACLES = {
    "op10_quality_rules": quality.OP10_SQL,
}
