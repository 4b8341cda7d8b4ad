"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bitslice, jaccard, langid, linededup, mixing, packing, quality, suffixes, toxicity, warc

QUERIES = {
    "op1_ppm_langid": langid.query,
    "op2_source_mixing": mixing.query,
    "op3_shingle_jaccard": jaccard.query,
    "op4_bitsliced_topk": bitslice.query,
    "op5_warc_archive": warc.query,
    "op6_suffix_dedup": suffixes.query,
    "op7_retrieval_packing": packing.query,
    "op8_toxicity_boosting": toxicity.query,
    "op9_quality_ratio": quality.query,
    "op10_line_chunks": linededup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_shingle_jaccard": jaccard.ORACLE,
    "op4_bitsliced_topk": bitslice.ORACLE,
    "op5_warc_archive": warc.ORACLE,
    "op6_suffix_dedup": suffixes.ORACLE,
}
