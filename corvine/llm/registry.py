"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvine.llm.ann import op9_ann
from corvine.llm.language import op5_language
from corvine.llm.mixing import OP1_SQL, op1_mixing
from corvine.llm.near_dup import op4_near_dup
from corvine.llm.packing import op2_packing
from corvine.llm.quality import op6_quality
from corvine.llm.rules import OP8_SQL, op8_quality_rules
from corvine.llm.secrets import op3_secrets
from corvine.llm.toxicity import op10_toxicity
from corvine.llm.warc import OP7_SQL, op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_packing": op2_packing,
        "op3_secrets": op3_secrets,
        "op4_near_dup": op4_near_dup,
        "op5_language": op5_language,
        "op6_quality": op6_quality,
        "op7_warc": op7_warc,
        "op8_quality_rules": op8_quality_rules,
        "op9_ann": op9_ann,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op7_warc": OP7_SQL, "op8_quality_rules": OP8_SQL}
