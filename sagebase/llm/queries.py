"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from sagebase.llm import audit, decontaminate, embeddings, language, mixing, rolling, sharding, shingles, sstable, substrings, tokencount, toxicity, warc

QUERIES = {
    "op1_benchmark_leaks": decontaminate.op1_benchmark_leaks,
    "op2_mix_to_weights": mixing.op2_mix_to_weights,
    "op3_warc_round_trip": warc.op3_warc_round_trip,
    "op4_embedding_near_duplicates": embeddings.op4_embedding_near_duplicates,
    "op5_toxic_segments": toxicity.op5_toxic_segments,
    "op6_repeated_substrings": substrings.op6_repeated_substrings,
    "op7_token_shards": sstable.op7_token_shards,
    "op8_byte_shards": sharding.op8_byte_shards,
    "op9_shingle_components": shingles.op9_shingle_components,
    "op10_token_counts": tokencount.op10_token_counts,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_byte_languages": language.op12_byte_languages,
    "op13_rolling_median": rolling.op13_rolling_median,
}

ORACLE_SQL = {
    "op8_byte_shards": sharding.OP8_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op13_rolling_median": rolling.OP13_SQL,
}
