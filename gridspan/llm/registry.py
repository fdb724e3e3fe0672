"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, lm_scoring, periodic, phrases, pieces, quality, secrets, simhash, token_codes, topk, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_exact_topk": topk.op3_exact_topk,
        "op4_quality": quality.op4_quality,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_simhash": simhash.op6_simhash,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_language": language.op8_language,
        "op9_token_codes": token_codes.op9_token_codes,
        "op10_warc": warc.op10_warc,
        "op11_lm_scoring": lm_scoring.op11_lm_scoring,
        "op12_collocations": phrases.op12_collocations,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {**url_filter.ORACLE, **topk.ORACLE, **warc.ORACLE, **phrases.ORACLE}
