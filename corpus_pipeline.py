"""The corpus pipeline: quality rules, quality classifier, near duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; between stages the rows are written as
Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import bpe_codec, mixing, ngram_rules, parity_join, pu_quality
from assay.llm.common import crc_bucket, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go: null, empty and short texts among them.

    Other rows stay with all their columns, repeated ones and those without doc_id as well.
    """
    trusted = ngram_rules.trusted_keys(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ngram_rules.keep_ruled(docs, trusted)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of poor quality go.

    It learns from rows whose doc_id is not held out; without trusted ones all rows stay. A null or empty text is scored
    like others; rows that repeat an id or have none, and columns of any name, stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = ngram_rules.trusted_keys(labels).where(crc_bucket(F.col("doc_id"), 5) != 0)
    return pu_quality.keep_good(docs, trusted, crc_bucket(F.col("doc_id"), 5) != 0, spark, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more.

    Every text that goes has one that stays and that links reach (see parity_join.one_of_each_group); documents
    without words, and rows that share a doc_id but no text, stay.
    """
    return parity_join.one_of_each_group(docs, spark, parity_join.Similarity(k=5, num=80, den=100))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights; a document comes as often as the mix draws it, each time as a whole.

    Rows without words are not drawn. A null source is one of its own; repeated rows are drawn one by one.
    """
    return mixing.draw(docs, spark, entire=True, with_shard=False)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, row by row: none for a null or empty text."""
    encoded = bpe_codec.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The classifier is fitted and the n-grams are hashed as no SQL does; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, spark)
    return docs
