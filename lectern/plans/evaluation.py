"""Evaluation queries. A customer is a question of the book of its market segment; its orders name what it expects, and also
what was found, where orders of low priority are off by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evaluate
from lectern.plans.register import query
from lectern.plans.search import _SIBLINGS, siblings
from lectern.sources.tables import table

_WANT = "SELECT DISTINCT c_mktsegment AS book_id, o_custkey AS q_id, o_orderkey % 40 AS section_id FROM orders JOIN customer ON o_custkey = c_custkey"
_GOT = "SELECT q_id, section_id, min(rank) AS rank FROM (SELECT o_custkey AS q_id, (o_orderkey + CAST(o_orderpriority = '5-LOW' AS INTEGER)) % 40 AS section_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) GROUP BY ALL"
_PER = f"""want AS ({_WANT}), got AS ({_GOT}),
per AS (SELECT book_id, q_id, count(*) AS n_expected, count(rank) AS n_found, coalesce(bool_or(rank = 1), false) AS top1,
          coalesce(string_agg(CASE WHEN rank IS NULL THEN section_id || '' END, ' ' ORDER BY section_id), '') AS missing FROM want LEFT JOIN got USING (q_id, section_id) GROUP BY book_id, q_id),
out AS (SELECT *, n_found > 0 AS hit, n_found = n_expected AS exact FROM per)"""


def labels(spark: SparkSession, sf_dir: str, sections: int = 40) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q_id"), F.col("c_mktsegment").alias("book_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q_id"), (F.col("o_orderkey") % sections).alias("section_id"))
    return o.join(c, "q_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    section = (F.col("o_orderkey") + (F.col("o_orderpriority") == "5-LOW").cast("int")) % 40
    return o.select(F.col("o_custkey").alias("q_id"), section.alias("section_id"), F.expr("cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint)").alias("rank"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcomes(labels(spark, sf_dir), found(spark, sf_dir))


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)


@query(f"WITH want AS ({_WANT.replace('% 40', '% 2500')}) SELECT book_id, q_id, string_agg(section_id || '', ' ' ORDER BY section_id) AS invalid FROM want WHERE section_id NOT IN (SELECT p_partkey FROM part) GROUP BY ALL")
def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = labels(spark, sf_dir, 2500)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("section_id"))
    there = wanted.select("book_id", "section_id").distinct().join(parts, "section_id", "left_semi")
    return evaluate.invalid_labels(wanted, there).select("book_id", "q_id", _joined("invalid"))


@query(f"WITH {_PER} SELECT book_id, count(*) AS total_questions, round(avg(CAST(top1 AS INTEGER)), 4) AS top1_accuracy, round(avg(CAST(hit AS INTEGER)), 4) AS topk_accuracy, round(avg(CAST(exact AS INTEGER)), 4) AS exact_accuracy FROM out GROUP BY book_id")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rates(outcomes(spark, sf_dir))


@query(f"""WITH {_PER}, s AS ({_SIBLINGS}), near AS (SELECT DISTINCT q_id, b AS section_id FROM want JOIN s ON a = section_id),
lost AS (SELECT q_id, count(*) FILTER (rank IS NULL) AS lost FROM near LEFT JOIN got USING (q_id, section_id) GROUP BY q_id)
SELECT book_id, count(*) AS total_questions, round(avg(CAST(hit AS INTEGER)), 4) AS shortlist_recall, round(avg(CAST(exact AS INTEGER)), 4) AS exact_shortlist_recall, count(*) FILTER (lost > 0) AS confusable_splits FROM out LEFT JOIN lost USING (q_id) GROUP BY book_id""")
def shortlist_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(evaluate.outcomes(labels(spark, sf_dir), found(spark, sf_dir), siblings(spark, sf_dir)))


@query(f"WITH {_PER} SELECT count(*) AS n_books, coalesce(min(a) >= 0.9, true) AS passed FROM (SELECT book_id, avg(CAST(top1 AS INTEGER)) AS a FROM out GROUP BY book_id)")
def accuracy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gate(evaluate.rates(outcomes(spark, sf_dir)))


@query(f"WITH {_PER} SELECT book_id, q_id, n_expected, n_found, hit, exact, missing FROM out WHERE NOT top1")
def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.misses(outcomes(spark, sf_dir)).withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), " "))


@query("SELECT count(*) AS n_books, count(*) FILTER (c_acctbal < 0) AS n_failed FROM customer")
def book_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.scans import book_states as states

    return states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_acctbal") >= 0).alias("ok")))
