"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, minhash, mixing, neighbours, packing, prefix_trie, quality, resampling, secrets, sstable, suffix_dedup, toxicity, trie_counts

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_secret_owners": secrets.op2_secret_owners,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_trie_token_counts": trie_counts.op4_trie_token_counts,
    "op5_anisotropic_neighbours": neighbours.op5_anisotropic_neighbours,
    "op6_quality_cascade": quality.op6_quality_cascade,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_sorted_shards": sstable.op8_sorted_shards,
    "op9_near_duplicates": minhash.op9_near_duplicates,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_conversation_trie": prefix_trie.op12_conversation_trie,
    "op13_chat_formatting": chat.op13_chat_formatting,
}
ORACLE = {
    "op2_secret_owners": secrets.SQL,
    "op6_quality_cascade": quality.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op9_near_duplicates": minhash.SQL,
    "op10_mix_sources": mixing.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op12_conversation_trie": prefix_trie.SQL,
    "op13_chat_formatting": chat.SQL,
}
