"""Operator 2: token totals for every context limit from an exact length histogram.

Documents are aggregated by encoded length, so only (length, count) pairs are
shuffled.  Suffix sums over the histogram then answer, for every limit, how
many documents reach it, how many tokens those hold, and how many tokens remain
when each document is cut at the limit.  The sums run in two levels, within
buckets of ``WIDTH`` lengths and over the buckets, so no task sees them all.

Defined results: a null or empty text has length 0; texts are encoded whole;
repeated rows count each; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from ._common import arrow, durable

WIDTH = 64


def histogram(docs: DataFrame, vocabulary_path: str, text_column: str = "text") -> DataFrame:
    """n_tokens, n_docs: documents by encoded length (no special tokens)."""

    def run(batches):
        encoder = bpe.of_merges(vocabulary_path)
        for batch in batches:
            sizes = [np.diff(off) for _, _, off in bpe.encoded(batch.column(0), encoder)]
            length, count = np.unique(np.concatenate([np.zeros(0, np.int64), *sizes]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(count, pa.int64())], ["n_tokens", "n"])

    parts = arrow(docs.select(F.col(text_column).cast("string").alias("text")), run, "n_tokens bigint, n bigint")
    return parts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row per occurring length, taken as a context limit.

    docs_from and tokens_from count documents at least that long, docs_upto and
    tokens_upto those at most that long; truncated_tokens is the sum of
    min(length, n_tokens); quantile is the share of documents at most that long.
    Between two rows truncated_tokens is linear, so they answer any limit.
    """
    hist = hist.withColumn("bucket", F.floor(F.col("n_tokens") / WIDTH)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = hist.groupBy("bucket").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    # one row per WIDTH lengths: bounded by the longest document, not by the number of documents
    everything = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    sums = sums.select(
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("docs").over(everything), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("all_tokens").over(everything), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(total).alias("docs_all"),
        F.sum("all_tokens").over(total).alias("tokens_all"),
    )
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    own = hist.select("*", F.sum("n_docs").over(within).alias("docs_in"), F.sum("tokens").over(within).alias("tokens_in"))
    out = own.join(sums, F.col("bucket") == F.col("b"))
    docs_from, tokens_from = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    below = F.col("tokens_all") - tokens_from
    return out.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("docs_all") - docs_from + F.col("n_docs")).alias("docs_upto"),
        (below + F.col("tokens")).alias("tokens_upto"),
        (below + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
        F.col("tokens_all").alias("total_tokens"),
        ((F.col("docs_all") - docs_from + F.col("n_docs")) / F.col("docs_all")).alias("quantile"),
    )


def token_counts(docs: DataFrame, vocabulary_path: str, text_column: str = "text") -> DataFrame:
    return limits(durable(histogram(docs, vocabulary_path, text_column), "lengths"))  # read twice, encoded once
