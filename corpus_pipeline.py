"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import language, mixing, packing, quality, similar
from wayline.llm.common import ensure_checkpoint_dir

#: least mean probability of the best language; a text of real words in a learned language lies far above
LEAST_LANGUAGE_SCORE = 0.35


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on length and repetition; the others, null texts among them, go."""
    return quality.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters or of no clear language go."""
    return language.keep_known(docs, language.fit_languages(docs), least=LEAST_LANGUAGE_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts alike: five-word shingles, similarity of 0.8 or more."""
    return similar.keep_one(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in shares that go with the square root of their size; a document comes as often as drawn."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all copies in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near copies", one_of_near_copies),
    ("mixing", target_mix),
    ("packing", packed),
]

#: a trained network decides in the second stage, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; each one's result is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
