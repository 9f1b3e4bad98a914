"""Keyword queries over documents: a source is a book, a document one of its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import keywords
from lectern.plans.register import query
from lectern.plans.sqltext import TERMS
from lectern.sources.tables import table


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("section_id"), "text")


@query(f"WITH {TERMS} SELECT book_id, section_id, by_tf AS rank, term, tf FROM ranked WHERE by_tf <= 15")
def tf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.tf_keywords(sections(spark, sf_dir))


@query(f"WITH {TERMS} SELECT * FROM dfs")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.document_frequency(keywords.term_counts(sections(spark, sf_dir)))


@query(f"WITH {TERMS} SELECT book_id, section_id, by_score AS rank, term, tf, df, score FROM ranked WHERE by_score <= 15")
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.tfidf_keywords(sections(spark, sf_dir))


_SETS = f"""{TERMS},
sets AS (SELECT doc_id AS section_id, source AS book_id,
                coalesce((SELECT list(term ORDER BY by_tf) FROM ranked r WHERE r.section_id = d.doc_id AND by_tf <= 15), []) AS kw,
                coalesce((SELECT list(term ORDER BY by_score) FROM ranked r WHERE r.section_id = d.doc_id AND by_score <= 15), []) AS ti
         FROM documents d),
unions AS (SELECT book_id, section_id, kw, ti, list_distinct(kw || ti) AS u FROM sets)"""


@query(f"WITH {_SETS} SELECT book_id, section_id, array_to_string(kw, ' ') AS keywords, array_to_string(ti, ' ') AS tfidf_keywords, array_to_string(kw || list_filter(ti, lambda x: NOT list_contains(kw, x)), ' ') AS all_keywords FROM unions")
def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = keywords.keyword_sets(sections(spark, sf_dir))
    return sets.select("book_id", "section_id", *[F.array_join(c, " ").alias(c) for c in ("keywords", "tfidf_keywords", "all_keywords")])


_PAIRS = f"""{_SETS},
pairs AS (SELECT book_id, a.section_id AS section_a, b.section_id AS section_b, list_sort(list_intersect(a.u, b.u)) AS shared, greatest(len(a.u), len(b.u)) AS larger
          FROM unions a JOIN unions b USING (book_id) WHERE a.section_id < b.section_id AND len(a.u) > 0 AND len(b.u) > 0),
near AS (SELECT book_id, section_a, section_b, round(len(shared) / larger, 2) AS overlap, shared FROM pairs WHERE len(shared) / larger > 0.6)"""


@query(f"WITH {_PAIRS} SELECT book_id, section_a, section_b, overlap, array_to_string(shared, ' ') AS shared_keywords FROM near")
def confusable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keywords.confusable_pairs(keywords.keyword_sets(sections(spark, sf_dir)))
    return pairs.withColumn("shared_keywords", F.array_join("shared_keywords", " "))


@query("""
SELECT a AS section_id, array_to_string(list(b ORDER BY b), ' ') AS siblings
FROM (SELECT p_partkey AS a, p_partkey + p_size AS b FROM part UNION SELECT p_partkey + p_size, p_partkey FROM part) GROUP BY a""")
def confusable_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    other = F.col("p_partkey") + F.col("p_size")
    once = part.select(F.col("p_partkey").alias("section_a"), other.alias("section_b"))
    twice = once.union(part.select(other, "p_partkey"))
    return keywords.confusable_map(twice).select("section_id", F.array_join(F.transform("siblings", lambda x: x.cast("string")), " ").alias("siblings"))
