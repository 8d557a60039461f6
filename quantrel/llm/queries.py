"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, lm_scoring, pii, quality_rules, sentencepiece_sampling, sharding, simhash, toxicity, url_filters, warc

QUERIES = {
    f.__name__: f
    for f in (
        sentencepiece_sampling.op1_gumbel_segmentations, toxicity.op2_ordinal_toxicity, url_filters.op3_url_language_ratio, decontamination.op4_winnowing_decontamination, pii.op5_chain_field_pii,
        lm_scoring.op6_stupid_backoff, warc.op7_seekable_warc, sharding.op8_weighted_hash_tree, quality_rules.op9_quality_rules, simhash.op10_simhash_pivots,
    )
}
ORACLES = {"op4_winnowing_decontamination": decontamination.ORACLE, "op6_stupid_backoff": lm_scoring.ORACLE, "op7_seekable_warc": warc.ORACLE, "op9_quality_rules": quality_rules.ORACLE}
