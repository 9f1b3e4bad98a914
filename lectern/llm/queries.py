"""The training-data queries: thin applications of the operators to whole tables, and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import chat, decontam, html_text, licenses, neardup, packing, quality, sharding, token_counts, token_store
from lectern.llm.common import table
from lectern.llm.sql import ORACLES

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=2048, end_id=0)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.export_then_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover(table(spark, sf_dir, "conversations"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"), quality.passes().alias("kept"), "failures")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=13)
    return found.withColumn("n_hit", decontam.n_hit()).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_packing, op3_sharding, op4_near_dedup, op5_token_counts, op6_token_files, op7_chat_format, op8_html_extraction, op9_quality_rules, op10_decontamination, pipeline)
}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
