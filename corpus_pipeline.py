"""Training-corpus pipeline over documents: toxicity, exact and near duplicates, source mixing, packing.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any name;
the operators' docstrings say what comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqweave.functions.shared import written
from seqweave.llm import exact_dedup, mixing, packing, pivots, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that op3's classifier marks toxic (score 0.3 or more), learnt from the table of labels; without
    labels nothing goes."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest doc_id; of rows that tie, the last by file and row."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 or more on shingles of five words, the row with the
    smallest doc_id; rows without a doc_id stay."""
    return pivots.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the temperature mix reads it, at most twice and at least once; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places in sequences of at most 2048 tokens; a null text gives the end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: The classifier and the packing can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, every stage applied to what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
