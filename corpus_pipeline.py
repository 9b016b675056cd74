"""A pipeline over documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from posetrail.llm import decontam, ngram_join, sentencepiece_bpe
from posetrail.llm.queries import table, vocabulary
from posetrail.llm.shared import free, stash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from posetrail.llm import quality

    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from posetrail.llm import pii

    return pii.replaced(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(docs.select("doc_id", "text"), vocabulary()))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_pii),
    ("SentencePiece", encode),
]

#: Word shingle groups, learned weights and merges are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{k}")
            free(before)  # nothing reads it any more
    return docs
