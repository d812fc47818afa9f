"""Operator 7, token counts: an exact histogram of encoded lengths, and what follows from its suffix sums.

Documents are encoded once; the histogram has a row for each distinct length.
Suffix sums over it answer, for every context limit, how many documents are at
least that long, how many tokens they hold, and how many tokens remain if all
documents are cut at the limit.

Null and empty texts have length 0; repeated rows count each; an empty table
gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import blocks
from .common import documents, stored, texts, tidy
from .tokens import BlockEncoder, default_tokenizer

#: Lengths that share a stretch of the two-level suffix sum.
STRETCH = 1024


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens: ids of the whole text, without special tokens."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder.open(path)
        for b in blocks(batches):
            raw = b.data.tobytes()
            _, n = encoder.encode([raw[i:j].decode("utf-8", "replace") for i, j in zip(b.at[:-1], b.at[1:])])
            yield pa.RecordBatch.from_arrays([b.doc_id, pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """length, n_docs and their suffix sums: docs_at_least, tokens_at_least, and truncated_tokens, the total when every document is cut at this length.

    Documents are encoded for the counts only, which are stored.
    """
    hist = lengths.groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n_docs")).filter("length is not null")
    return suffix_sums(stored(hist, "histogram"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The sums of a stored table with length and n_docs. They have two levels, first over stretches of lengths and then within one, so that no task gets all distinct lengths."""
    hist = hist.withColumn("_stretch", F.floor(F.col("length") / STRETCH)).withColumn("_tokens", F.col("length") * F.col("n_docs"))
    after = Window.orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        hist.groupBy("_stretch")
        .agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
        .select("_stretch", F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_docs_after"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_tokens_after"))
    )
    inside = Window.partitionBy("_stretch").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(later, "_stretch").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("_docs_after")).alias("docs_at_least"),
        (F.sum("_tokens").over(inside) + F.col("_tokens_after")).alias("tokens_at_least"),
    )
    totals = hist.agg(F.sum("n_docs").alias("_all_docs"), F.sum("_tokens").alias("_all_tokens"))
    return out.crossJoin(F.broadcast(totals)).select(  # one row
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("_all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("_all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        F.col("_all_docs").alias("total_docs"),
        F.col("_all_tokens").alias("total_tokens"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least this share of the documents does not exceed."""
    least = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("docs_at_most") >= float(s) * F.col("total_docs"), F.col("length"))).alias("length")) for s in shares]
    return histogram.agg(F.array(*least).alias("_all")).select(F.inline("_all")).filter("length is not null")


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, total: tokens that remain when every document is cut at the limit; any limit, not only lengths that occur.

    A limit is a length that no document has, so its suffix sums are its answer.
    """
    wanted = histogram.sparkSession.createDataFrame([(int(x), 0) for x in set(limits)], "length long, n_docs long")
    both = histogram.select("length", "n_docs").union(wanted).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    return suffix_sums(stored(both, "limits")).join(wanted.select("length"), "length", "left_semi").select(F.col("length").alias("context_limit"), F.col("truncated_tokens").alias("total"))


@tidy
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(documents(spark, sf_dir)))
