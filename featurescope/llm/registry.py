"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import jaccard, langid, url_filter, warc_zip
from .ann_tree import op8_kmeans_tree
from .decontamination import op1_pigeonhole_myers
from .packing import op6_harmonic_packing
from .pii import op7_pii_boosted
from .token_files import op9_token_files
from .toxicity import op10_toxicity_cnn

QUERIES = {
    "op1_pigeonhole_myers": op1_pigeonhole_myers,
    "op2_fragment_jaccard": jaccard.op2_fragment_jaccard,
    "op3_url_lm_ratio": url_filter.op3_url_lm_ratio,
    "op4_zip_warc": warc_zip.op4_zip_warc,
    "op5_rank_order_langid": langid.op5_rank_order_langid,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_pii_boosted": op7_pii_boosted,
    "op8_kmeans_tree": op8_kmeans_tree,
    "op9_token_files": op9_token_files,
    "op10_toxicity_cnn": op10_toxicity_cnn,
}

ORACLE_SQL: dict[str, str] = {
    "op2_fragment_jaccard": jaccard.ORACLE_SQL,
    "op5_rank_order_langid": langid.ORACLE_SQL,
    "op3_url_lm_ratio": url_filter.ORACLE_SQL,
    "op4_zip_warc": warc_zip.ORACLE_SQL,
}
