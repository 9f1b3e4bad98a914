"""From raw documents to packed training sequences: quality rules, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; all but the last return the columns of
documents. A stage's result is written as Parquet to the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, neardup, packing, quality
from lectern.llm.common import staged, table, unstage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 rejects go. Every row is judged on its own: null and empty texts have too few words and go,
    repeated rows and ids stay as they are. Columns stay as they were, whatever their names; no rows give none."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, 0.8) one row with the smallest doc_id stays. Null doc_ids come last in a
    class, of equal ones any stays; texts without words all stay. Columns stay as they were; no rows give none."""
    return neardup.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; what remains of benchmark passages in others is cut out, and their n_chars, where there is
    such a column, follows. Null and empty texts hold no words and stay; repeated rows and ids are searched one by one; other
    columns stay as they were; no rows, or no benchmark, leave what there is."""
    cleaned = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    out = {c: F.col("text") if c == "text" else F.col("doc").getField(c) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("was_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return cleaned.select(*[x.alias(c) for c, x in out.items()])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens. A null or empty text is its end id alone; null and
    repeated ids and repeated rows are packed one by one; other columns are ignored; no rows give none."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicate classes and minimum bin slack aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_staged_at"):
            unstage(before)
    return docs
