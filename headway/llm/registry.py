"""The corpus queries by name, and SQL for those that SQL expresses."""

from headway.llm import exact_dedup, media, mixing, near_dedup, packing, pii, prefix_trie, preference, substring_dedup, toxicity, url_filter, warc, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_media": media.op5_media,
    "op6_preference": preference.op6_preference,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_warc_index": warc.op11_warc_index,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op6_preference": preference.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_warc_index": warc.OP11_SQL,
}
