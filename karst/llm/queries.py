"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from karst.llm.extraction import op9_html_extraction
from karst.llm.language import op8_language_id
from karst.llm.mixing import op10_mixing
from karst.llm.near_dups import ORACLE_SQL as NEAR_DUPS_SQL
from karst.llm.near_dups import op1_minhash_near_dedup
from karst.llm.packing import op2_packing
from karst.llm.pii import op6_pii
from karst.llm.quality import op7_quality_rules
from karst.llm.token_counts import op4_token_counts
from karst.llm.toxicity import op3_toxicity
from karst.llm.vector_dups import ORACLE_SQL as VECTOR_DUPS_SQL
from karst.llm.vector_dups import op5_vector_near_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_token_counts": op4_token_counts,
        "op5_vector_near_dedup": op5_vector_near_dedup,
        "op6_pii": op6_pii,
        "op7_quality_rules": op7_quality_rules,
        "op8_language_id": op8_language_id,
        "op9_html_extraction": op9_html_extraction,
        "op10_mixing": op10_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return found | {
        "op1_minhash_near_dedup": NEAR_DUPS_SQL,
        "op5_vector_near_dedup": VECTOR_DUPS_SQL,
    }
