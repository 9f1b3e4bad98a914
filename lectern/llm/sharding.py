"""Contiguous shards of near equal bytes from global prefix sums; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bases, ranged


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Deals all documents (doc_id, text; other columns are ignored) into shards by the law ``bytes``.

    Rows are put in order of doc_id (null first) over range partitions; sums of the partitions' totals give each row the
    bytes before it in the whole corpus, and a row belongs to the shard in which its middle byte falls when the corpus is
    cut at equal targets. So shards are contiguous in doc_id and differ from the target by one document at most. Texts
    aren't moved: only ids, sizes and checksums are. Where a shard begins is looked up in the few partitions that lie across
    a cut; every other one belongs to a single shard.

    size is the UTF-8 length and 1 (null: 1). Rows that are equal or share a doc_id are dealt one by one, in any order
    among them; an empty table gives no row. Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # tie lets a range boundary fall within rows that share a doc_id
    sizes = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    dealt = ranged(sizes, "sizes", F.col("doc_id").asc_nulls_first(), F.col("tie"))

    def holds(twice: str):
        """The shard of a byte of the corpus; twice: two times its place."""
        return F.expr(f"cast(least({shards - 1}, ({twice}) * {shards} div (2 * bytes_all)) as int)")

    before = bases(dealt, bytes=F.sum("size"), rows=F.count("*")).withColumns({"first_shard": holds("2 * bytes_base"), "last_shard": holds("2 * (bytes_base + bytes)")})
    upto = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, 0)

    def placed(own: DataFrame, parts: DataFrame) -> DataFrame:
        running = own.withColumns({"own_bytes": F.sum("size").over(upto), "own_row": F.row_number().over(upto)})
        return running.join(F.broadcast(parts), "part").withColumns({"shard": holds("2 * (bytes_base + own_bytes) - size"), "row": F.col("rows_base") + F.col("own_row") - 1})

    across = before.where("first_shard <> last_shard")  # at most a partition a cut
    found = placed(dealt.join(F.broadcast(across.select("part")), "part", "left_semi"), across).select("shard", "row")
    first = before.where("first_shard = last_shard").select(F.col("first_shard").alias("shard"), F.col("rows_base").alias("row")).union(found).groupBy("shard").agg(F.min("row").alias("first"))
    return placed(dealt, before).join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
