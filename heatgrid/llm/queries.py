"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heatgrid.llm import chat, divergence, html_text, langid, line_dedup, order_minhash, packing, pivots, simhash, spelling, token_counts, transducer, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": chat.op1_chat_formatting,
        "op2_warc": warc.op2_warc,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
        "op5_order_minhash": order_minhash.op5_order_minhash,
        "op6_language_id": langid.op6_language_id,
        "op7_embedding_near_dedup": pivots.op7_embedding_near_dedup,
        "op8_sentencepiece": transducer.op8_sentencepiece,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE, "op2_warc": warc.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op7_embedding_near_dedup": pivots.ORACLE, "op11_source_divergence": divergence.ORACLE}
