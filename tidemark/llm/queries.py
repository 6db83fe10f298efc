"""The queries of this subpackage and their DuckDB SQL."""

from tidemark.llm import audit, chat, licences, mixing, pages, pseudonyms, simhash, suffixes, tokens, toxicity, trie, vectors, webp

QUERIES = {
    "op1_multinomial_mix": mixing.op1,
    "op2_licence_classifier": licences.op2,
    "op3_tag_path_text": pages.op3,
    "op4_chat_perspectives": chat.op4,
    "op5_longest_match_tokens": tokens.op5,
    "op6_feistel_pseudonyms": pseudonyms.op6,
    "op7_webp_lossless": webp.op7,
    "op8_suffix_decontamination": suffixes.op8,
    "op9_simhash_pivots": simhash.op9,
    "op10_compression_toxicity": toxicity.op10,
    "op11_prefix_digests": trie.op11,
    "op12_filter_cube": audit.op12,
    "op13_pivot_range_join": vectors.op13,
}
ORACLES = {
    "op4_chat_perspectives": chat.ORACLE,
    "op8_suffix_decontamination": suffixes.ORACLE,
    "op11_prefix_digests": trie.ORACLE,
    "op12_filter_cube": audit.ORACLE,
}
