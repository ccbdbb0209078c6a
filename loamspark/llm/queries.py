"""The registered queries of this package, one for each operator, and the pipeline; with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, html_text, language, licenses, pieces, secrets, simhash, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_simhash": simhash.op2_simhash,
        "op3_licenses": licenses.op3_licenses,
        "op4_urls": urls.op4_urls,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_chat": chat.op6_chat,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_html": html_text.op9_html,
        "op10_language": language.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return secrets.SQL | chat.SQL | exact_dedup.SQL
