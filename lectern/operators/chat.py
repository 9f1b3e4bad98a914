"""The conversation store as tables: books, their threads, the threads' messages. Changes give new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("user", "assistant")


def upsert_books(books: DataFrame, new: DataFrame) -> DataFrame:
    """books with the rows of new (book_id, display_name, created_at) in place of those with the same id."""
    return books.join(new.select("book_id"), "book_id", "left_anti").select("book_id", "display_name", "created_at").union(new.select("book_id", "display_name", "created_at"))


def delete_threads(threads: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the threads of gone (thread_id) and their messages."""
    ids = gone.select("thread_id").distinct()
    return threads.join(ids, "thread_id", "left_anti"), messages.join(ids, "thread_id", "left_anti")


def delete_books(books: DataFrame, threads: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three without the books of gone (book_id), their threads and those threads' messages."""
    ids = gone.select("book_id").distinct()
    lost = threads.join(ids, "book_id", "left_semi")
    return books.join(ids, "book_id", "left_anti"), *delete_threads(threads, messages, lost)


def rename_thread(threads: DataFrame, thread_id: str, title: str) -> DataFrame:
    return threads.withColumn("title", F.when(F.col("thread_id") == thread_id, title).otherwise(F.col("title")))


def add_messages(threads: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appends messages of existing threads with a valid role, and moves those threads' updated_at up."""
    valid = new.where(F.col("role").isin(*ROLES)).join(threads.select("thread_id"), "thread_id", "left_semi").select(*messages.columns)
    latest = valid.groupBy("thread_id").agg(F.max("created_at").alias("latest"))
    touched = threads.join(latest, "thread_id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("latest", "updated_at")))
    return touched.select(*threads.columns), messages.union(valid)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent doesn't exist: what a foreign key would have refused."""
    return child.join(parent.select(key), key, "left_anti")


def list_books(books: DataFrame) -> DataFrame:
    return books.orderBy("display_name")


def list_threads(threads: DataFrame, book_id: str) -> DataFrame:
    return threads.where(F.col("book_id") == book_id).orderBy(F.col("updated_at").desc(), "thread_id")


def list_messages(messages: DataFrame, thread_id: str) -> DataFrame:
    return messages.where(F.col("thread_id") == thread_id).orderBy("created_at", "message_id")


def available(books: DataFrame, sections: DataFrame) -> DataFrame:
    """Registered books that have processed content."""
    return books.join(sections.select("book_id"), "book_id", "left_semi")
