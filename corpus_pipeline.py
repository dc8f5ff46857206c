"""The corpus pipeline: stages that each take documents and return documents, the last one their digests.

Every stage's result is written as Parquet in the shared folder and read back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from reelspan.llm.common import stash, table, tagged
from reelspan.llm.queries import VOCABULARY


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1."""
    rows, key = tagged(docs)
    good = quality.classify(rows, table(spark, sf_dir, "labels"), row_col=key).where("predicted = 1").select(key)
    return rows.join(good, key, "left_semi").select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def dissimilar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return jaccard_join.drop_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, key = tagged(docs)
    taken = mixing.mix(rows, row_col=key).where("copies > 0").select(key, F.sequence(F.lit(1).cast("long"), "copies").alias(f"{key}taken"))
    return rows.join(taken, key).withColumn(f"{key}copy", F.explode(f"{key}taken")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of token ids and of what they decode to."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality", good_texts), ("exact dedup", distinct_texts), ("near copies", dissimilar_texts), ("mixing", mixed), ("byte bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs


#: A classifier and hashed choices are no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
