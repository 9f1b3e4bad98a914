"""Outlines: headings, page ranges, parents, chapters, trees and routable candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions import text as X
from lectern.functions.words import STRUCTURAL_IDS


def body_size(spans: DataFrame) -> DataFrame:
    """book_id, body_size: the font size, to half a point, that sets most characters; of equal ones the first seen."""
    sizes = spans.select("book_id", (F.round(F.col("size") * 2) / 2).alias("half"), F.length("text").cast("long").alias("chars"), F.struct("page", "block", "line", "span").alias("at"))
    per = sizes.groupBy("book_id", "half").agg(F.sum("chars").alias("chars"), F.min("at").alias("at"))
    order = Window.partitionBy("book_id").orderBy(F.col("chars").desc(), "at")
    return per.withColumn("r", F.row_number().over(order)).where("r = 1").select("book_id", F.col("half").alias("body_size"), "chars")


def font_headings(spans: DataFrame, s=DEFAULTS) -> DataFrame:
    """Headings by font: lines with a span far larger than the body, or bold and larger; level by their ratio.

    One row a line (book_id, page, block, line, title, level) of at least three characters.
    """
    bold = (F.col("flags").bitwiseAND(F.lit(16)) != 0) | F.lower("font").rlike("bold|black|heavy")
    sized = spans.join(body_size(spans), "book_id")
    ratio = F.col("size") / F.col("body_size")
    heading = (ratio >= s.heading_ratio) | (bold & (ratio >= s.bold_heading_ratio))
    line = sized.where(heading).groupBy("book_id", "page", "block", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]).alias("parts"), F.max(ratio).alias("ratio"))
    level = F.when(F.col("ratio") >= s.level1_ratio, 1).when(F.col("ratio") >= s.level2_ratio, 2).otherwise(3)
    titled = line.select("book_id", "page", "block", "line", X.strip(X.squeeze(F.array_join("parts", " "))).alias("title"), level.alias("level"))
    return titled.where(F.length("title") >= 3)


def regex_headings(pages: DataFrame) -> DataFrame:
    """Headings by their wording: book_id, page, line, title, level of pages (book_id, page, text)."""
    flat = pages.select("book_id", "page", F.posexplode(X.lines("text")).alias("line", "raw"))
    return flat.withColumn("level", X.heading_level("raw")).where("level is not null").select("book_id", "page", "line", X.strip("raw").alias("title"), "level")


def first_outline(*tiers: tuple[DataFrame, int]) -> DataFrame:
    """For each book the entries of the first tier that has enough of them; toc_idx counts in order of page."""
    taken, out = None, None
    for entries, least in tiers:
        enough = entries.groupBy("book_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("book_id")
        fresh = enough if taken is None else enough.join(taken, "book_id", "left_anti")
        own = entries.join(fresh, "book_id", "left_semi").select("book_id", "level", "title", "start_page", "ord")
        taken, out = (fresh, own) if out is None else (taken.union(fresh), out.union(own))
    order = Window.partitionBy("book_id").orderBy("start_page", "ord")
    return out.withColumn("toc_idx", (F.row_number().over(order) - 1).cast("int")).drop("ord")


def page_ranges(toc: DataFrame, last_pages: DataFrame) -> DataFrame:
    """toc with start_page clamped to the book and end_page: the page before the next entry, but never before its own."""
    order = Window.partitionBy("book_id").orderBy("toc_idx")
    clamp = lambda c: F.greatest(F.lit(0), F.least(c, F.col("last_page")))
    clamped = toc.join(last_pages, "book_id").withColumn("start_page", clamp(F.col("start_page")))
    end = F.greatest("start_page", F.least(F.lead("start_page").over(order) - 1, F.col("last_page")))
    return clamped.withColumn("end_page", F.coalesce(end, "last_page")).drop("last_page")


def _before(rows: int | None = -1):
    return Window.partitionBy("book_id").orderBy("toc_idx").rowsBetween(Window.unboundedPreceding, rows)


def parents(toc: DataFrame) -> DataFrame:
    """toc with parent_idx: the nearest earlier entry of a lower level; null at level 1. The levels are read from the data."""
    levels = sorted(r.level for r in toc.select("level").distinct().where("level is not null").collect())
    last = [F.when(F.col("level") > max(k, 1), F.last(F.when(F.col("level") == k, F.col("toc_idx")), ignorenulls=True).over(_before())) for k in levels[:-1]]
    none = F.lit(None).cast("int")
    return toc.withColumn("parent_idx", F.greatest(*last, none, none))


def chapters(toc: DataFrame, own_counts: bool = False) -> DataFrame:
    """toc with chapter: the title of the nearest earlier level-1 entry. With own_counts a level-1 entry is its own chapter
    (as for recognised blocks); else it has the one before it, and its own title where there's none."""
    found = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(_before(0 if own_counts else -1))
    return toc.withColumn("chapter", F.coalesce(found, F.when(F.col("level") == 1, F.col("title")), F.lit("Front Matter" if own_counts else "Untitled Chapter")))


def unique_slugs(titles: DataFrame, group: str = "book_id", order: str = "toc_idx", title: str = "title", empty: str = "") -> DataFrame:
    """titles with section_id: the slug, from its second use on with -1, -2 and so on."""
    s = F.coalesce(F.nullif(X.slug(title), F.lit("")), F.lit(empty))
    n = F.row_number().over(Window.partitionBy(group, "slug").orderBy(order)) - 1
    return titles.withColumn("slug", s).withColumn("section_id", F.when(n == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", n))).drop("slug")


def children(nodes: DataFrame) -> DataFrame:
    """book_id, parent_id, children in order, of parents that exist."""
    heads = nodes.select("book_id", F.col("node_id").alias("parent_id"))
    kept = nodes.where("parent_id is not null").join(heads, ["book_id", "parent_id"], "left_semi")
    return kept.groupBy("book_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]).alias("children"))


def roots(nodes: DataFrame) -> DataFrame:
    """nodes with is_root: no parent, or one that doesn't exist."""
    heads = nodes.select("book_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("found"))
    return nodes.join(heads, ["book_id", "parent_id"], "left").withColumn("is_root", F.col("found").isNull()).drop("found")


def routable(section_id: str | Column) -> Column:
    c = X.col(section_id)
    return ~(c.isin(*STRUCTURAL_IDS) | c.rlike(r"\A\p{L}\z"))


def supplementary(title: str | Column) -> Column:
    return X.col(title).rlike(X.SUPPLEMENTARY)


def flatten(nodes: DataFrame, depth: int = 8) -> DataFrame:
    """Candidates of a forest (book_id, node_id, parent_id, ord, title) in pre-order: adds chapter_title (the root's title),
    parent_title, depth, path and is_deprioritized. Structural sections are left out, but not what is below them.

    Every node looks one ancestor further up at a time; after ``depth`` of them the rest are counted, and it goes on while any
    of them comes to its root. What then remains is on a cycle or below one, and is left out.
    """
    up = nodes.select(F.col("book_id").alias("up_book"), F.col("node_id").alias("up_id"), F.col("title").alias("up_title"), F.col("ord").alias("up_ord"), F.col("parent_id").alias("next"))
    out = nodes.select("book_id", "node_id", "title", F.col("title").alias("chapter_title"), F.lit("").alias("parent_title"), F.array("ord").alias("path"), F.col("parent_id").alias("above"))
    found = F.col("up_id").isNotNull()
    left, before, k = None, None, 0
    while left is None or (left and left != before):
        for k in range(k, k + depth):
            out = out.join(up, F.expr("book_id = up_book and above = up_id"), "left").select(
                "book_id", "node_id", "title",
                F.when(found, F.col("up_title")).otherwise(F.col("chapter_title")).alias("chapter_title"),
                (F.when(found, F.col("up_title")).otherwise("") if k == 0 else F.col("parent_title")).alias("parent_title"),
                F.when(found, F.concat(F.array("up_ord"), "path")).otherwise(F.col("path")).alias("path"),
                F.col("next").alias("above"),
            )
        k += 1
        before, left = left, out.where("above is not null").count()
    out = out.where("above is null").drop("above")
    return out.where(routable("node_id")).withColumns({"depth": F.size("path"), "is_deprioritized": supplementary("title")})
