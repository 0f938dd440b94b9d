"""Queries of the llm operators, in the order of their numbers, and their SQL oracles."""

from __future__ import annotations

from larkspur.llm import chat, filter_audit, sharding, vector_codes
from larkspur.llm.binary_packing import op12_binary_packing
from larkspur.llm.chat import op2_chat_format
from larkspur.llm.decontamination import op8_suffix_decontamination
from larkspur.llm.filter_audit import op11_filter_audit
from larkspur.llm.nearest import op9_anisotropic_neighbours
from larkspur.llm.ngram_join import op1_ngram_jaccard
from larkspur.llm.packing import op6_best_fit_packing
from larkspur.llm.pii import op4_skip_chain_pii
from larkspur.llm.sharding import op7_stratified_shards
from larkspur.llm.token_counts import op3_token_counts
from larkspur.llm.token_files import op5_token_orc
from larkspur.llm.toxicity import op10_toxicity
from larkspur.llm.vector_codes import op13_vector_codes


def queries():
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_chat_format": op2_chat_format,
        "op3_token_counts": op3_token_counts,
        "op4_skip_chain_pii": op4_skip_chain_pii,
        "op5_token_orc": op5_token_orc,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_stratified_shards": op7_stratified_shards,
        "op8_suffix_decontamination": op8_suffix_decontamination,
        "op9_anisotropic_neighbours": op9_anisotropic_neighbours,
        "op10_toxicity": op10_toxicity,
        "op11_filter_audit": op11_filter_audit,
        "op12_binary_packing": op12_binary_packing,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql():
    return {
        "op2_chat_format": chat.ORACLE_SQL,
        "op7_stratified_shards": sharding.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
