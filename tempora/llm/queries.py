"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tempora.llm import chat, decontaminate, fingerprint, mixing, ngram_join, quality, substring_dedup, suffix_dedup, token_files, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_mixing": mixing.op6_mixing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_chat": chat.op8_chat,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_files": token_files.op10_token_files,
}
ORACLES = {
    "op5_ngram_join": ngram_join.SQL,
    "op6_mixing": mixing.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op8_chat": chat.SQL,
    "op9_decontaminate": decontaminate.SQL,
}
