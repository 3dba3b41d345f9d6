"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from trendlens.llm import (
    bpe,
    chat,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    lattice_lm,
    licenses,
    mixing,
    quality,
    suffix_array,
    suffix_tree,
    vector_codes,
    warc,
)

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_suffix_array_dedup": suffix_array.op3_suffix_array_dedup,
    "op4_suffix_tree_dedup": suffix_tree.op4_suffix_tree_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_lattice_lm": lattice_lm.op7_lattice_lm,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_warc": warc.op11_warc,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE = {
    "op1_chat_format": chat.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_suffix_array_dedup": suffix_array.SQL,
    "op4_suffix_tree_dedup": suffix_tree.SQL,
    "op5_license_scan": licenses.SQL,
    "op6_jaccard_join": jaccard_join.SQL,
    "op8_mix_sources": mixing.SQL,
    "op11_warc": warc.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
