"""Deciding how a book is read: sampled page lengths, classification, recognition chunks and their states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULTS
from lectern.functions import text as X


def is_sampled(page: str | Column, total: str | Column, group: int = DEFAULTS.sample_group) -> Column:
    """The first, middle and last pages of a book (from 0); all of a short one."""
    p, n = X.col(page), X.col(total)
    middle = F.floor(n / 2) - group // 2
    return (n <= 3 * group) | (p < group) | ((p >= middle) & (p < middle + group)) | (p >= n - group)


def sample_pages(pages: DataFrame, group: int = DEFAULTS.sample_group) -> DataFrame:
    """pages (book_id, page, text) that classification looks at, with total_pages."""
    totals = pages.groupBy("book_id").agg(F.count("*").alias("total_pages"))
    return pages.join(totals, "book_id").where(is_sampled("page", "total_pages", group))


def classify(pages: DataFrame, s=DEFAULTS) -> DataFrame:
    """book_id, classification, needs_force_ocr, avg_chars_per_page (one place), total_pages, pages_sampled."""
    sampled = sample_pages(pages, s.sample_group)
    per = sampled.groupBy("book_id").agg(F.avg(F.length(X.strip("text"))).alias("a"), F.first("total_pages").alias("total_pages"), F.count("*").alias("pages_sampled"))
    return per.select(
        "book_id",
        F.when(F.col("a") < s.scanned_below, "scanned").otherwise("text").alias("classification"),
        (F.col("a") < s.force_ocr_below).alias("needs_force_ocr"),
        F.round("a", 1).alias("avg_chars_per_page"),
        "total_pages",
        "pages_sampled",
    )


def chunk_plan(books: DataFrame, size: int = DEFAULTS.chunk_pages) -> DataFrame:
    """book_id, chunk, first_page, last_page (from 0, both within) of books (book_id, total_pages)."""
    n = F.ceil(F.col("total_pages") / size).cast("int")
    flat = books.where("total_pages > 0").select("book_id", "total_pages", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return flat.select("book_id", "chunk", (F.col("chunk") * size).cast("long").alias("first_page"), F.least((F.col("chunk") + 1) * size, "total_pages").cast("long").alias("last_page")).withColumn("last_page", F.col("last_page") - 1)


def pending(plan: DataFrame, states: DataFrame) -> DataFrame:
    """Chunks that no run has finished: a rerun takes these alone."""
    done = states.where(F.col("status").isin("success", "cached")).select("book_id", "chunk")
    return plan.join(done, ["book_id", "chunk"], "left_anti")


def run_chunks(chunks: DataFrame, make_runner: Callable[[], Callable[[str, int, int], str]]) -> DataFrame:
    """Runs recognition of each chunk (book_id, chunk, first_page, last_page) and adds status and output. The runner, made
    once a task, takes the book and its pages and returns the recognised blocks as JSON; it brings its own time limit, and
    whatever it raises makes that chunk failed and leaves the others alone. Write the result and take pending() for a rerun.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = make_runner()

        def one(book, first, last):
            try:
                return "success", runner(book, int(first), int(last))
            except Exception:  # noqa: BLE001  one chunk's failure, of any kind, is its own
                return "failed", None

        for pdf in batches:
            done = [one(*x) for x in zip(pdf["book_id"], pdf["first_page"], pdf["last_page"], strict=True)]
            yield pdf.assign(status=[d[0] for d in done], output=[d[1] for d in done])

    own = chunks.select("book_id", "chunk", "first_page", "last_page")
    return own.mapInPandas(run, T.StructType([*own.schema.fields, T.StructField("status", T.StringType()), T.StructField("output", T.StringType())]))


def chunk_states(states: DataFrame) -> DataFrame:
    """book_id, n_success, n_cached, n_failed, all_failed."""
    counts = {k: F.count_if(F.col("status") == k) for k in ("success", "cached", "failed")}
    return states.groupBy("book_id").agg(*[v.alias(f"n_{k}") for k, v in counts.items()], (counts["failed"] == F.count("*")).alias("all_failed"))


def book_states(states: DataFrame) -> DataFrame:
    """n_books, n_failed over all books (book_id, ok)."""
    return states.agg(F.count("*").alias("n_books"), F.count_if(~F.col("ok")).alias("n_failed"))
