"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, encoder, strings, written

#: Lengths a block of the two-level prefix sums spans.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row per document: n_tokens, the length of its ids (null and empty texts: 0)."""

    def make():
        enc = encoder(tokenizer)
        width = enc.dtype.itemsize
        return lambda batch: pa.record_batch([pa.array([len(enc.packed(x)) // width for x in strings(batch, text)], pa.int64())], ["n_tokens"])

    return arrow_map(docs.select(text), make, "n_tokens long")


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): partial counts meet before the shuffle, so one hot length costs nothing."""
    return lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: what a context limit of L keeps.

    n_docs, tokens: at exactly L. docs_to, tokens_to: at L or less. docs_from, tokens_from: at L or
    more (suffix sums). tokens_cut: tokens left if every document is cut to L. docs_share: the rank
    of L as a quantile. Sums run within blocks of 1024 lengths and over the blocks, so no task sees
    more than a block, and a row for each block. An empty table gives no rows.
    """
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(blocks, "block")
        .withColumn("docs_to", F.col("d0") + F.sum("n_docs").over(upto))
        .withColumn("tokens_to", F.col("t0") + F.sum("tokens").over(upto))
        .withColumn("docs_from", F.col("d_all") - F.col("docs_to") + F.col("n_docs"))
        .withColumn("tokens_from", F.col("t_all") - F.col("tokens_to") + F.col("tokens"))
        .withColumn("tokens_cut", F.col("tokens_to") + F.col("n_tokens") * (F.col("d_all") - F.col("docs_to")))
        .withColumn("docs_share", F.col("docs_to") / F.col("d_all"))
        .select("n_tokens", "n_docs", "tokens", "docs_to", "tokens_to", "docs_from", "tokens_from", "tokens_cut", "docs_share")
    )


def totals_at(totals: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, tokens_cut, docs_over) for any limits, read off the totals of context_totals."""
    spark = totals.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    kept = F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("tokens")).otherwise(F.col("context_limit") * F.col("n_docs"))
    over = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)
    found = totals.join(asked, F.lit(True)).groupBy("context_limit").agg(F.sum(kept).alias("tokens_cut"), F.sum(over).alias("docs_over"))
    return asked.join(found, "context_limit", "left").na.fill(0)


def quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that so large a share of documents does not exceed."""
    asked = F.broadcast(totals.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return totals.join(asked, F.col("docs_share") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """context_totals of the documents' encoded lengths. Extra columns are ignored.

    The totals read the histogram twice, so it is written: texts are encoded once.
    """
    return context_totals(written(length_histogram(encoded_lengths(docs, tokenizer, text)), "histogram"))
