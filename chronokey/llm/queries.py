"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import html_text, mixing, mixing_lm, near_vectors, ngram_join, packing, prefix_forest, quality, sharding, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kd_shards": sharding.op1_kd_shards,
        "op2_packing": packing.op2_packing,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_mixing_lm": mixing_lm.op4_mixing_lm,
        "op5_near_vectors": near_vectors.op5_near_vectors,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_html_text": html_text.op7_html_text,
        "op8_prefix_forest": prefix_forest.op8_prefix_forest,
        "op9_mix": mixing.op9_mix,
        "op10_quality": quality.op10_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mix": mixing.OP9_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
