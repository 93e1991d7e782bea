"""Corpus pipeline: each stage gets all that the one before it kept, is written as Parquet and read again.

Toxic documents go, one document of each near-duplicate class stays, documents with benchmark windows go, the rest are
repeated or left out until each source has its share of the words, and what remains is written as token files.

Defined cases, of all stages: a null text is an empty one, and like an empty or a very long one is judged as any other; a null
doc_id, lang or source is a value of its own; equal rows are judged alike (near-dedup leaves one of them); an empty table
stays empty; all columns are handed on but by the last stage, also ones that carry names used inside the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import dartminhash, decontaminate, mixing, tokens, toxicity
from sparkloom.llm.common import fresh_dir, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on ``labels``, does not find toxic; a text without words has the chain's share and stays.

    Labels that are null or of no document train nothing."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest doc_id (null last); texts without words are one class."""
    return dartminhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ``benchmark``; items without words have none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words get the whole copies that their source is due."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the token files, read back from them: doc_id, start, n_tokens, ids_crc32, a row per document."""
    return tokens.round_trip(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]
ORACLE_SQL = None  # no stage but the third can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
