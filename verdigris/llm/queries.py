"""The registered queries of the training-data operators, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, lexical_search, mixing, packing, pieces, prefix_trie, quality, simhash, suffix_dedup, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat.op1_query,
    "op2_simhash_near_dedup": simhash.op2_query,
    "op3_exact_dedup": exact_dedup.op3_query,
    "op4_suffix_array_dedup": suffix_dedup.op4_query,
    "op5_toxicity": toxicity.op5_query,
    "op6_token_counts": token_counts.op6_query,
    "op7_source_mixing": mixing.op7_query,
    "op8_quality_rules": quality.op8_query,
    "op9_sentencepiece": pieces.op9_query,
    "op10_warc": warc.op10_query,
    "op11_best_fit_packing": packing.op11_query,
    "op12_ranked_search": lexical_search.op12_query,
    "op13_prefix_trie": prefix_trie.op13_query,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_source_mixing": mixing.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_ranked_search": lexical_search.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
