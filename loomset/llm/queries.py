"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from loomset.llm import chat_format, decontaminate, divergence, exact_dedup, lang_id, line_dedup, mix_sources, near_dedup, prefix_trie, quality, sharding, token_counts, toxicity

QUERIES = {"op1_chat_format": chat_format.op1_chat_format, "op2_lang_id": lang_id.op2_lang_id, "op3_toxicity": toxicity.op3_toxicity, "op4_mix_sources": mix_sources.op4_mix_sources, "op5_decontaminate": decontaminate.op5_decontaminate, "op6_line_dedup": line_dedup.op6_line_dedup, "op7_exact_dedup": exact_dedup.op7_exact_dedup, "op8_quality": quality.op8_quality, "op9_token_counts": token_counts.op9_token_counts, "op10_near_dedup": near_dedup.op10_near_dedup, "op11_source_divergence": divergence.op11_source_divergence, "op12_sharding": sharding.op12_sharding, "op13_prefix_trie": prefix_trie.op13_prefix_trie}
ORACLES = {"op1_chat_format": chat_format.OP1_SQL, "op4_mix_sources": mix_sources.OP4_SQL, "op5_decontaminate": decontaminate.OP5_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op11_source_divergence": divergence.OP11_SQL, "op12_sharding": sharding.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
