"""Operators of a training-data pipeline and their queries."""

from . import exact, language, licenses, manifest, mixing, packing, perplexity, quality, sharding, simhash, tokenfile, trie, vectors

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_lm_scores": perplexity.op2,
    "op3_shards": sharding.op3,
    "op4_quality": quality.op4,
    "op5_token_files": tokenfile.op5,
    "op6_simhash": simhash.op6,
    "op7_packing": packing.op7,
    "op8_exact_dedup": exact.op8,
    "op9_language": language.op9,
    "op10_vector_dedup": vectors.op10,
    "op11_conversation_trie": trie.op11,
    "op12_license_scan": licenses.op12,
    "op13_merkle_manifest": manifest.op13,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op8_exact_dedup": exact.ORACLE,
    "op11_conversation_trie": trie.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
