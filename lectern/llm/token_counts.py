"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bases, blank_null, ranged, ship, staged
from lectern.llm.encode import encoder


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length, n_docs: documents (null text: empty, of length 0) by encoded length. Each task counts its own first; the
    result is staged, so that texts are encoded once whatever is asked of it."""
    ship(docs.sparkSession)

    def run(batches):
        enc, seen = encoder(tokenizer), Counter()
        for batch in batches:
            seen.update(len(enc.encode(t)) // 4 for t in batch["text"].to_pylist())
        if seen:
            yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "n_docs"])

    own = docs.select(blank_null("text").alias("text")).mapInArrow(run, "length long, n_docs long")
    return staged(own.groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "histogram")


def limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: docs_fit (of at most that length), docs_over, tokens_fit,
    truncated_total (tokens left if every document is cut there), share_fit (the quantile of that length).

    Lengths lie in range partitions; sums run within one and over the totals of those before it, so that no task holds all
    lengths. An empty histogram gives no row.
    """
    own = ranged(histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens")), "lengths", F.col("length"))
    upto = Window.partitionBy("part").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    return (
        own.withColumns({"in_docs": F.sum("n_docs").over(upto), "in_tokens": F.sum("n_tokens").over(upto)})
        .join(F.broadcast(bases(own, docs=F.sum("n_docs"), tokens=F.sum("n_tokens"))), "part")
        .withColumns({"docs_fit": F.col("docs_base") + F.col("in_docs"), "tokens_fit": F.col("tokens_base") + F.col("in_tokens")})
        .withColumn("docs_over", F.col("docs_all") - F.col("docs_fit"))
        .select(
            "length", "n_docs", "n_tokens", "docs_fit", "docs_over", "tokens_fit",
            (F.col("tokens_fit") + F.col("length") * F.col("docs_over")).alias("truncated_total"),
            (F.col("docs_fit") / F.col("docs_all")).alias("share_fit"),
        )
    )


def total(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0)).alias("n_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left at any limit, also one that no document has."""
    return histogram.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of the documents does not exceed; no row for an empty histogram."""
    return limits(histogram).where(F.col("share_fit") >= q).agg(F.min("length").alias("length")).where("length is not null")
