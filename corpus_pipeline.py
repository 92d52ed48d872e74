"""Corpus pipeline: quality rules, exact dedup, near dedup, source mixing, packing; each stage is written and read again.

All stages but the last return the columns of their input, whatever their names. Rows that repeat a doc_id, also null ones, are rows of their own
everywhere; null and blank texts fail the quality rules' base and go there. A stage by itself treats them as its operator says: blank texts are one
exact group, are near to nothing, come once in mixing, and are packed as an end id. Very long texts are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import materialize
from gridloom.llm.op3_superminhash import near_dedup
from gridloom.llm.op5_exact import exact_dedup
from gridloom.llm.op6_mixing import mixed_documents
from gridloom.llm.op7_packing import pack_documents
from gridloom.llm.op8_quality import filter_quality
from gridloom.llm.tokens import path_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the learned decision list."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (four fifths of their five-word shingles are common) the one with the smallest doc_id."""
    return near_dedup(docs, size=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document is lost; small sources come up to one and a half times."""
    return mixed_documents(docs, most_epochs=1.5, budget="whole")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return pack_documents(docs, path_of("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: Signatures, learned rules and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
