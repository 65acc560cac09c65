"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import bpe, embeddings, language, minhash, mixing, passages, secrets, sharding, simhash, urls

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_simhash_fingerprints": simhash.op3_simhash_fingerprints,
    "op4_url_filter": urls.op4_url_filter,
    "op5_shard_documents": sharding.op5_shard_documents,
    "op6_substring_dedup": passages.op6_substring_dedup,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_language_id": language.op9_language_id,
    "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
}

#: The others cannot be put in SQL; their tests hold them against brute force.
ORACLES = {
    "op1_minhash_near_dedup": minhash.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op4_url_filter": urls.OP4_SQL,
    "op6_substring_dedup": passages.OP6_SQL,
    "op10_embedding_near_dedup": embeddings.OP10_SQL,
}
