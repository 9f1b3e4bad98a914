"""Conversation store queries: conversations are threads of books, turns are messages a minute apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chat
from lectern.plans.register import query
from lectern.sources.tables import table

_MESSAGES = "SELECT conv_id || ':' || turn AS message_id, conv_id || '' AS thread_id, role, text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn + conv_id * 7) AS created_at FROM conversations"
_THREADS = f"SELECT thread_id, 'b' || CAST(thread_id AS BIGINT) % 9 AS book_id, 'New chat' AS title, min(created_at) AS created_at, min(created_at) AS updated_at FROM ({_MESSAGES}) GROUP BY ALL"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_seconds(1704067200 + 60 * (turn + conv_id * 7))")
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.col("conv_id").cast("string").alias("thread_id"), "role", F.col("text").alias("content"), at.alias("created_at"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = messages(spark, sf_dir).groupBy("thread_id").agg(F.min("created_at").alias("created_at"))
    book = F.concat(F.lit("b"), F.col("thread_id").cast("long") % 9)
    return first.select("thread_id", book.alias("book_id"), F.lit("New chat").alias("title"), "created_at", F.col("created_at").alias("updated_at"))


def _seconds(c: str):
    return F.unix_seconds(c).alias(c)


@query(f"SELECT thread_id, title, CAST(epoch(updated_at) AS BIGINT) AS updated_at FROM ({_THREADS}) WHERE book_id = 'b4'")
def list_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.list_threads(threads(spark, sf_dir), "b4").select("thread_id", "title", _seconds("updated_at"))


@query(f"SELECT message_id, role, content FROM ({_MESSAGES}) WHERE thread_id = '11'")
def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.list_messages(messages(spark, sf_dir), "11").select("message_id", "role", "content")


@query(f"""SELECT thread_id, book_id, CAST(epoch(greatest(t.updated_at, coalesce(latest, t.updated_at))) AS BIGINT) AS updated_at FROM ({_THREADS}) t
LEFT JOIN (SELECT thread_id, max(created_at) AS latest FROM ({_MESSAGES}) WHERE role IN ('user', 'assistant') GROUP BY ALL) USING (thread_id)""")
def thread_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = messages(spark, sf_dir)
    touched, _ = chat.add_messages(threads(spark, sf_dir), new.where("false"), new)
    return touched.select("thread_id", "book_id", _seconds("updated_at"))


@query(f"SELECT message_id, thread_id FROM ({_MESSAGES}) WHERE CAST(thread_id AS BIGINT) % 9 <> 4")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = threads(spark, sf_dir)
    books = t.select("book_id").distinct()
    _, _, left = chat.delete_books(books, t, messages(spark, sf_dir), books.where("book_id = 'b4'"))
    return left.select("message_id", "thread_id")


@query("SELECT coalesce(n.k, c.c_custkey) || '' AS book_id, coalesce(n.c_mktsegment, c.c_name) AS display_name FROM customer c FULL JOIN (SELECT 3 * c_custkey AS k, c_mktsegment FROM customer) n ON c.c_custkey = n.k")
def upsert_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp").alias("created_at")
    c = table(spark, sf_dir, "customer")
    books = c.select(F.col("c_custkey").cast("string").alias("book_id"), F.col("c_name").alias("display_name"), at)
    new = c.select((3 * F.col("c_custkey")).cast("string").alias("book_id"), F.col("c_mktsegment").alias("display_name"), at)
    return chat.upsert_books(books, new).select("book_id", "display_name")


@query("SELECT c_custkey AS book_id, c_name AS display_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def books_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("display_name"))
    return chat.available(books, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id")))


@query("SELECT conv_id, turn FROM conversations WHERE role NOT IN ('user', 'assistant')")
def refused_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(~F.col("role").isin(*chat.ROLES)).select("conv_id", "turn")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END FROM customer)")
def orphaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("key"))
    return chat.orphans(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), parent, "key").select("o_orderkey")
