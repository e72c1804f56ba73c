"""A training corpus from raw documents: quality rules, one document of each near-duplicate class, personal data masked,
sources mixed to target weights, and the texts as SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakline.llm import jaccard_join, mixing, pii, quality_rules, sentencepiece_viterbi
from peakline.llm.common import documents, stored
from peakline.llm.queries import MIX_COPIES, MIX_SHARE, MIX_WEIGHTS, PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that lose too much, or fail the word rules, go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays."""
    return jaccard_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs, MIX_WEIGHTS, MIX_SHARE, MIX_COPIES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint32) of every document in the mix."""
    return sentencepiece_viterbi.encode(docs, PIECES)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources", mixture), ("SentencePiece", tokens)]
#: The signature forest, the span model and the segmentation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
