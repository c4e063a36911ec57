"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvine.llm.common import run_folder, written
from corvine.llm.mixing import mixed_documents
from corvine.llm.near_dup import drop_near_duplicates
from corvine.llm.packing import default_tokenizer, pack, packed_digest
from corvine.llm.secrets import redact_secrets
from corvine.llm.toxicity import drop_toxic, learn, learnable


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; learned from the labels' training rows."""
    model = learn(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles with a
    similarity of 0.8 or more. Documents without words are no copies and stay."""
    return drop_near_duplicates(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kinds."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often and as far as they are taken."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, as their digest columns."""
    return packed_digest(pack(docs, default_tokenizer()))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: The learned stage can't be said in SQL; tests/llm/test_pipeline.py holds what run()
#: makes, stage by stage, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
