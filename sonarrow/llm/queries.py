"""The numbered queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from . import q_bpe, q_classify, q_fim, q_jaccard, q_lm, q_media, q_mixing, q_neighbours, q_tokens, q_urls, q_whitening

QUERIES, ORACLE_SQL = {}, {}
for _m in (q_mixing, q_urls, q_classify, q_media, q_tokens, q_jaccard, q_neighbours, q_lm, q_whitening, q_bpe, q_fim):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= getattr(_m, "ORACLE_SQL", {})
