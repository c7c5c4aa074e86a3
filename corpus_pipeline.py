"""A corpus pipeline of five stages, each on all that the stage before it kept.

Part of the training-data subpackage.  Every stage is written as Parquet and read again before the next one.

Defined results: null and empty texts are scored like any other; where the classifier keeps them, the one with the
smallest id stays (null counts as empty), and packing gives it its end token.  Rows that repeat an id and a text are copies
and fall to one; those that repeat an id with different texts are documents of their own.  Very long texts go through
whole and are cut into pieces by packing only.  Without usable labels all scores are equal, and all documents stay.  An
empty table gives an empty table.  Further columns of documents are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gaugeweave.llm import exact_dedup, mixing, ngram_join, packing, quality
from gaugeweave.llm.queries import _tokenizer
from gaugeweave.llm.shared import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest id."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs.select(*COLUMNS), _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_classifier", good),
    ("exact_dedup", distinct),
    ("ngram_jaccard_join", dissimilar),
    ("mix_sources", mixed),
    ("best_fit_packing", packed),
]

#: The classifier's fit and the near-duplicate join can't be said in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
