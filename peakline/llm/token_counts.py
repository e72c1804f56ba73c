"""Token counts of a corpus by an exact length histogram.

Documents are encoded once and only their lengths are kept, as a histogram (length, documents). Sums from the longest
length downwards then answer, for every context limit, how many documents and tokens are longer, how many tokens
remain when documents are cut at the limit, and which share of the documents fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from peakline.llm.bpe import encoder
from peakline.llm.common import in_arrow, stored, whole_text

#: Lengths whose suffix sums are taken in one window.
BLOCK = 4096


def token_lengths(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row; a null text is empty and has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            lengths = [len(ids) // 4 for ids in encode.batch(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return narrow.transform(in_arrow, run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs): each task adds up its own rows before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """One row for every context limit that some document's length equals.

    Columns: `context_limit`; `docs` of that length; `docs_within` (not longer) and `docs_over`; `tokens_within` of those not longer;
    `truncated_tokens`, what is left of the whole corpus when documents are cut at the limit; `total_tokens`; `quantile`, the share of documents
    not longer. A limit between two lengths is answered by the row of the next lower length: every longer document adds the difference
    (`tokens_at`). Suffix sums are taken inside blocks of lengths and over the blocks, so no window sees all lengths. An empty
    corpus has no rows.
    """
    cells = stored(histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs")))
    blocks = cells.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"))
    whole = cells.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("total_tokens"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    over = F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("docs_above")
    tokens_over = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens_above")
    # `whole` is one row of two sums.
    summed = cells.join(blocks, "block").crossJoin(F.broadcast(whole)).withColumn("docs_over", over).withColumn("tokens_over", tokens_over)
    return summed.select(
        F.col("n_tokens").alias("context_limit"), "docs", (F.col("all_docs") - F.col("docs_over")).alias("docs_within"), "docs_over",
        (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"), "total_tokens",
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"))


def tokens_at(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_over) for any limits, from a `limit_table`."""
    asked = table.sparkSession.createDataFrame(pd.DataFrame({"asked": pd.Series(limits, dtype="int64")}), "asked long")
    lower = F.broadcast(asked).join(table, F.col("context_limit") <= F.col("asked")).groupBy("asked").agg(
        F.max_by(F.struct("truncated_tokens", "docs_over", "context_limit"), "context_limit").alias("at"))
    everything = table.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"))
    at = F.col("at")
    return asked.join(lower, "asked", "left").crossJoin(F.broadcast(everything)).select(
        F.col("asked").alias("context_limit"),
        F.when(at.isNull(), F.col("n") * F.col("asked")).otherwise(at["truncated_tokens"] + at["docs_over"] * (F.col("asked") - at["context_limit"])).alias("truncated_tokens"),
        F.when(at.isNull(), F.col("n")).otherwise(at["docs_over"]).alias("docs_over"))


def quantile_length(table: DataFrame, share: float) -> int | None:
    """The smallest length that at least `share` of the documents do not exceed; None for an empty corpus."""
    return table.filter(F.col("quantile") >= share).agg(F.min("context_limit")).first()[0]
