"""A corpus pipeline: documents in, packed batches of clean and distinct documents out."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from presswire.llm import decontamination, jaccard, packing, quality, toxicity
from presswire.llm.common import ready, table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity. Null and empty texts have no evidence and
    stay with the base rate; repeated rows stay or go alike; no documents give none."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of grade 1 or better at least as likely as not; null texts count as
    empty, repeated rows stay or go alike."""
    return quality.keep_good(docs, quality.grade_labels(table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, once if it
    repeats; documents without words are copies of each other, null texts among them."""
    ready(spark)
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, each judged by its own text; null texts hold none."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all that is left, every row in one batch; null texts are empty."""
    ready(spark)
    return packing.pack(docs)


STAGES = [("toxicity", not_toxic), ("quality", good_quality), ("near_duplicates", distinct), ("decontamination", decontaminated), ("packing", packed)]

ORACLE_SQL = None  # trained models and fingerprints are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
