"""Incremental counterparts: books arrive as files, messages as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lectern import schemas
from lectern.sources.tables import write_sections


def new_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages (book_id, page, text) of Parquet files as they arrive; the checkpoint remembers which were taken."""
    return spark.readStream.schema(schemas.PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(pages: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Takes all pages that are there and stops. Each batch's books are built (build: pages to sections with book_id) and
    replace their own partitions, so a batch that is run again after a failure gives the same table.

    A book may come in several batches: pages are kept beside the checkpoint's own files, and a batch builds its books from
    all of their pages so far. A page that comes again in a later batch replaces the earlier one.
    """
    store = f"{checkpoint.rstrip('/')}/pages_seen"

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{store}/batch={n}")
        kept = StructType([*df.schema.fields, StructField("batch", LongType())])
        seen = df.sparkSession.read.schema(kept).parquet(store)
        books = seen.where(F.col("batch") == n).select(F.col("book_id").alias("own")).distinct()
        own = seen.join(books, F.col("book_id").eqNullSafe(F.col("own")), "left_semi")
        last = F.max("batch").over(Window.partitionBy("book_id", "page"))
        write_sections(build(own.withColumn("last", last).where("batch = last").select(*df.columns)), out)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def thread_activity(messages: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Messages and last activity of each thread in a window of time; messages later than ``late`` are left out."""
    timed = messages.withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", every), "thread_id").agg(F.count("*").alias("n_messages"), F.max("created_at").alias("last_at")).select("thread_id", F.col("window.start").alias("day"), "n_messages", "last_at")
