"""One query per corpus operator, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from peakline.llm import (chat_format, fill_middle, imatch, jaccard_join, mixing, periodic_runs, pii, quality_rules, ranking, repair, sentencepiece_viterbi,
                          suffix_dedup, token_counts)
from peakline.llm.common import documents, scratch_path

#: Sources in code point order, null last, weigh these in turn and share this part of all sizes; no document is taken more often.
MIX_WEIGHTS, MIX_SHARE, MIX_COPIES = (5.0, 2.0, 1.0), 1.5, 2
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: A conversation whose texts hold control strings, formatted with the others.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), MIX_WEIGHTS, MIX_SHARE, MIX_COPIES)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(documents(spark, sf_dir), BYTE_BPE)
    return token_counts.limit_table(token_counts.length_histogram(lengths))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("clean_text")


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    counts = [F.size(F.filter(F.col("base")["kind"], (lambda kind: lambda x: x == kind)(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, as a count and a CRC-32 of little-endian uint32, and the text decoded from them again."""
    encoded = sentencepiece_viterbi.encode(documents(spark, sf_dir), PIECES)
    decoded = sentencepiece_viterbi.decode(encoded, PIECES)
    return decoded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op7_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(documents(spark, sf_dir), BYTE_BPE, scratch_path(spark, "ids"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(documents(spark, sf_dir))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_format.round_trip(turns.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapse(documents(spark, sf_dir), periodic_runs.repeated_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_jaccard_join, op3_token_counts, op4_imatch, op5_suffix_dedup, op6_sentencepiece, op7_repair_ids, op8_quality_rules, op9_quality_ranking, op10_pii,
                                op11_fill_middle, op12_chat_format, op13_periodic_runs)}
SQL: dict[str, str] = {"op2_jaccard_join": jaccard_join.sql(), "op8_quality_rules": quality_rules.sql(), "op11_fill_middle": fill_middle.sql(),
                       "op12_chat_format": chat_format.sql("VALUES " + ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in CONTROL_TURNS))}
