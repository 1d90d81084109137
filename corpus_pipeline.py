"""From raw documents to packed sequences: language, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm import decontaminate, jaccard, langid, packing, pii
from gantry.session import discard, materialise, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; letterless and unsure ones go, and text that costs far more than any learned language. The trees are learned from the documents' own labels."""
    return langid.keep_identified(docs, langid.learn(docs), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 80 % of five-word shingles."""
    return jaccard.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold half of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced; n_chars is that of the new text."""
    out = pii.replace(docs, key=pii.session_key(spark)).drop("n_replaced")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]
#: SQL can't express byte context trees, tokenizers and keyed surrogates; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written and read again as the next one's documents, and its own tables are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = written(spark)
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(spark, [p for p in written(spark)[:-1] if p not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
