"""The queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textgate.llm import bpe, chat, decontaminate, html_text, langid, ngram_join, sharding, spotsigs, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": url_filter.op1_url_filters,
        "op2_sharding": sharding.op2_sharding,
        "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_language_id": langid.op5_language_id,
        "op6_html_extraction": html_text.op6_html_extraction,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_fingerprints": spotsigs.op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": ngram_join.SQL, "op4_chat_formatting": chat.SQL, "op7_decontamination": decontaminate.SQL}
