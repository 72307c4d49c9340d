"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tesserine.llm import bpe, jaccard, merkle, minhash, mixing, neighbours, perplexity, preference, secrets, suffixes, tokenfile, toxicity, whitening

QUERIES = {
    "op1_suffix_dedup": suffixes.op1,
    "op2_hilbert_neighbours": neighbours.op2,
    "op3_toxicity": toxicity.op3,
    "op4_preference_formatting": preference.op4,
    "op5_source_mixing": mixing.op5,
    "op6_quality_rules": perplexity.op6,
    "op7_token_files": tokenfile.op7,
    "op8_secret_scans": secrets.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_bpe": bpe.op10,
    "op11_minhash_duplicates": minhash.op11,
    "op12_embedding_whitening": whitening.op12,
    "op13_merkle_manifest": merkle.op13,
}

SQL = {
    "op4_preference_formatting": preference.OP4_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op8_secret_scans": secrets.OP8_SQL,
    "op11_minhash_duplicates": minhash.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
