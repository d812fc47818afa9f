"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import media, minhash, mixing, packing, pii, quality, secrets, suffixes, token_counts, toxicity

_QUERIES = (
    suffixes.op1_suffix_dedup,
    toxicity.op2_toxicity,
    packing.op3_packing,
    media.op4_media,
    pii.op5_pii,
    mixing.op6_mixing,
    token_counts.op7_token_counts,
    quality.op8_quality,
    minhash.op9_minhash,
    secrets.op10_secrets,
)


def queries() -> dict:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.ORACLE_SQL}
