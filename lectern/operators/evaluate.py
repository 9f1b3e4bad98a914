"""Evaluation of routing against labelled questions. Labels and results are rows, so any number of questions will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS


def invalid_labels(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """book_id, q_id, invalid (sorted): expected sections that can't be routed to. labels: book_id, q_id, section_id."""
    bad = labels.join(candidates.select("book_id", "section_id"), ["book_id", "section_id"], "left_anti")
    return bad.groupBy("book_id", "q_id").agg(F.array_sort(F.collect_set("section_id")).alias("invalid"))


def outcomes(labels: DataFrame, shortlisted: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """One row a labelled question: n_expected, n_found, hit (any), exact (all), top1, missing (sorted), and with siblings
    (section_id, siblings) involved and n_missing_siblings. shortlisted: q_id, section_id, rank."""
    want = labels.select("book_id", "q_id", "section_id").distinct()
    got = shortlisted.select("q_id", "section_id", "rank").groupBy("q_id", "section_id").agg(F.min("rank").alias("rank"))
    per = (
        want.join(got, ["q_id", "section_id"], "left")
        .groupBy("book_id", "q_id")
        .agg(
            F.count("*").alias("n_expected"),
            F.count("rank").alias("n_found"),
            F.coalesce(F.bool_or(F.col("rank") == 1), F.lit(False)).alias("top1"),
            F.array_sort(F.collect_set(F.when(F.col("rank").isNull(), F.col("section_id")))).alias("missing"),
        )
    )
    out = per.withColumns({"hit": F.col("n_found") > 0, "exact": F.col("n_found") == F.col("n_expected")})
    if siblings is None:
        return out
    near = want.join(siblings, "section_id").select("q_id", F.explode("siblings").alias("section_id")).distinct()
    lost = near.join(got, ["q_id", "section_id"], "left").groupBy("q_id").agg(F.count_if(F.col("rank").isNull()).alias("n_missing_siblings"))
    return out.join(lost, "q_id", "left").withColumns({"involved": F.col("n_missing_siblings").isNotNull(), "n_missing_siblings": F.coalesce("n_missing_siblings", F.lit(0))})


def _share(c: str, places: int = 4):
    return F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), places)


def rates(results: DataFrame) -> DataFrame:
    """book_id, total_questions, top1_accuracy, topk_accuracy, exact_accuracy."""
    return results.groupBy("book_id").agg(F.count("*").alias("total_questions"), _share("top1").alias("top1_accuracy"), _share("hit").alias("topk_accuracy"), _share("exact").alias("exact_accuracy"))


def recall(results: DataFrame) -> DataFrame:
    """book_id, total_questions, shortlist_recall, exact_shortlist_recall, confusable_splits."""
    split = F.col("involved") & (F.col("n_missing_siblings") > 0)
    return results.groupBy("book_id").agg(F.count("*").alias("total_questions"), _share("hit").alias("shortlist_recall"), _share("exact").alias("exact_shortlist_recall"), F.count_if(split).alias("confusable_splits"))


def gate(book_rates: DataFrame, least: float = DEFAULTS.accuracy_gate) -> DataFrame:
    """One row: n_books, passed (every book's top-1 accuracy is high enough; true without books)."""
    return book_rates.agg(F.count("*").alias("n_books"), F.coalesce(F.min("top1_accuracy") >= least, F.lit(True)).alias("passed"))


def misses(results: DataFrame) -> DataFrame:
    """Questions without a first-rank hit, as they are written out."""
    return results.where(~F.col("top1")).select("book_id", "q_id", "n_expected", "n_found", "hit", "exact", "missing")
