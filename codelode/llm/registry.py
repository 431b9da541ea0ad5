"""Queries of this subpackage."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_centroid_clustering
from .chat import OP13_SQL, op13_chat_formatting
from .decontamination import op10_decontamination
from .language_id import op1_language_id
from .merkle import OP12_SQL, op12_merkle_manifest
from .near_duplicates import op9_near_duplicates
from .packing import op4_packing
from .pii_surrogates import op6_pii_surrogates
from .quality_divergence import op7_quality_divergence
from .secret_scan import op3_secret_scan
from .sql import OP2_SQL, OP3_SQL, OP7_SQL, OP9_SQL
from .substring_dedup import op2_substring_dedup
from .toxicity import op8_toxicity
from .warc import OP5_SQL, op5_warc_round_trip

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_quality_divergence": op7_quality_divergence,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_chat_formatting": op13_chat_formatting,
}
#: The other operators (language models, tokens, keyed permutations, alignment) have no SQL form; tests/llm holds them against
#: brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_secret_scan": OP3_SQL,
    "op5_warc_round_trip": OP5_SQL,
    "op7_quality_divergence": OP7_SQL,
    "op9_near_duplicates": OP9_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_chat_formatting": OP13_SQL,
}
