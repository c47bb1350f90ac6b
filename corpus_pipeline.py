"""From raw documents to packed training sequences: each stage is one operator, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import without_ids
from tessella.llm.decontam import without_leaks
from tessella.llm.line_dedup import dedup_lines
from tessella.llm.packing import pack_documents
from tessella.llm.simhash import near_duplicates
from tessella.llm.toxicity import without_toxic
from tessella.scratch import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 40 code points or more that five documents or more share, but for the last holder."""
    return dedup_lines(docs).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near-duplicates."""
    spare = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return without_ids(docs, stored(spare, "near-duplicates"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a stretch of a benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all ids into sequences of at most 2048."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned scores, fingerprints and BPE ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
