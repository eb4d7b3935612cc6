"""The training-data pipeline: toxicity, exact copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm import decontamination, exact_dedup, packing, simhash_dedup, toxicity
from tallyglass.llm.common import staged


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject.

    Null text is scored as empty; each row is judged by its own text, whatever its id; without labels of both classes
    nothing is rejected unless the share of toxic labels itself reaches the threshold.
    """
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(source, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those whose texts are equal but for the case of A-Z: that with the largest id.

    Null and empty texts are equal; a null id stays only where its group has no other; of rows that repeat id and text
    one stays.
    """
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of those linked by five-word shingles at a similarity of 0.8 or more.

    Texts without words are one group; shorter texts are one shingle; ids that repeat or are null take no other rows
    along.
    """
    return simhash_dedup.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to four fifths of its shingles or more.

    Each row is judged by its own text; null and empty texts hold nothing; an empty benchmark rejects nothing.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 2,048; null and empty texts are a piece of the end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]
#: Learned scores and fingerprints are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
