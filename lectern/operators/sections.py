"""Sections of books: text of page ranges, repeated margins, tiny sections, length outliers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions import text as X


def range_text(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, toc_idx, text: the texts of pages start_page to end_page of each entry, in order, joined by line feeds.

    Ranges are spelled out page by page, so this is an equi-join: the work is the pages covered, however ranges overlap.
    """
    wanted = entries.select("book_id", "toc_idx", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    held = wanted.join(pages.select("book_id", "page", "text"), ["book_id", "page"])
    texts = held.groupBy("book_id", "toc_idx").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return texts.select("book_id", "toc_idx", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def margin_lines(pages: DataFrame, n: int = DEFAULTS.margin_lines) -> DataFrame:
    """book_id, page, line (normalised): the first and last n lines of each page, each line once a page."""
    all_lines = X.lines("text")
    own = pages.select("book_id", "page", all_lines.alias("l"))
    ends = F.concat(F.slice("l", 1, n), F.slice("l", F.greatest(F.size("l") - n + 1, F.lit(1)), n))
    norm = F.array_distinct(F.transform(ends, lambda x: X.normal_line(x)))
    return own.select("book_id", "page", F.explode(F.filter(norm, lambda x: F.length(x) >= 3)).alias("line"))


def repeating_lines(pages: DataFrame, ratio: float = DEFAULTS.repeat_ratio, n: int = DEFAULTS.margin_lines, min_pages: int = DEFAULTS.repeat_min_pages) -> DataFrame:
    """book_id, line, n_pages of lines that stand in the margins of a share of their book's pages. None for short books."""
    totals = pages.groupBy("book_id").agg(F.count("*").alias("total")).where(F.col("total") >= min_pages)
    counts = margin_lines(pages, n).groupBy("book_id", "line").agg(F.count("*").alias("n_pages"))
    return counts.join(totals, "book_id").where(F.col("n_pages") >= F.col("total") * ratio).select("book_id", "line", "n_pages")


def strip_repeating(pages: DataFrame, repeating: DataFrame) -> DataFrame:
    """pages without the lines whose normal form is repeating, wherever they stand; texts stay in their rows, and what is
    joined is the list of lines of a book."""
    listed = repeating.groupBy("book_id").agg(F.collect_set("line").alias("drop"))
    kept = F.filter(X.lines("text"), lambda x: ~F.array_contains(F.col("drop"), X.normal_line(x)))
    joined = pages.join(listed, "book_id", "left")
    return joined.withColumn("text", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("drop")


def length_outliers(sections: DataFrame, long: float = DEFAULTS.outlier_long, short: float = DEFAULTS.outlier_short) -> DataFrame:
    """Sections far from the median length of their book: section_id, n_chars, ratio (two places), kind."""
    sized = sections.select("book_id", "section_id", F.length("text").cast("long").alias("n_chars"))
    # an exact median of counted lengths: lengths are aggregated first, so a book of any size gives a bounded histogram
    counts = sized.groupBy("book_id", "n_chars").agg(F.count("*").alias("n"))
    medians = counts.groupBy("book_id").agg(F.expr("percentile(n_chars, 0.5, n)").alias("median"))
    ratio = F.col("n_chars") / F.col("median")
    kind = F.when((F.col("median") > 0) & (ratio > long), "long").when((F.col("median") > 0) & (ratio < short), "short")
    return sized.join(medians, "book_id").withColumn("kind", kind).where("kind is not null").select("book_id", "section_id", "n_chars", F.round(ratio, 2).alias("ratio"), "kind")


def merge_plan(rows: list[tuple[str, int, str | None, int]], below: int) -> list[tuple[int, list[int]]]:
    """The sequential fold of one book's sections, given in order as (section_id, level, parent_id, length): for each that
    stays, whose texts it holds, in order. A short one goes in front of the next section of its level, as long as no lower
    level comes before it, else of its parent; what its target has become in turn counts."""
    first: dict[str, int] = {}
    for i, r in enumerate(rows):
        first.setdefault(r[0], i)
    pieces, length, into = [[i] for i in range(len(rows))], [r[3] for r in rows], {}
    for i, (_, level, parent, _) in enumerate(rows):
        if i in into or length[i] >= below:
            continue
        target = None
        for j in range(i + 1, len(rows)):
            if j not in into and rows[j][1] <= level:
                target = j if rows[j][1] == level else None
                break
        if target is None and parent in first:
            target = first[parent]
            while target in into:
                target = into[target]
        if target is not None and target != i:
            pieces[target] = pieces[i] + pieces[target]
            length[target] += length[i] + 1
            into[i] = target
    return [(i, p) for i, p in enumerate(pieces) if i not in into]


def merge_tiny(sections: DataFrame, below: int = DEFAULTS.tiny_section_chars) -> DataFrame:
    """Sections (book_id, ord, section_id, level, parent_id, text) without those under ``below`` characters, whose texts go
    to a neighbour or parent that stays.

    A target grows before it is itself judged, so each book is folded in order by one task. Only ids, levels and lengths
    go there; the texts are put together by a join on what the fold decided.
    """
    own = sections.select("book_id", F.col("ord").cast("long").alias("ord"), "section_id", F.col("level").cast("int").alias("level"), "parent_id", F.coalesce("text", F.lit("")).alias("text"))
    book = next(f.dataType.simpleString() for f in own.schema if f.name == "book_id")
    schema = f"book_id {book}, ord long, piece int, target long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        parents = [None if pd.isna(x) else x for x in pdf["parent_id"]]
        found = merge_plan(list(zip(pdf["section_id"], pdf["level"], parents, pdf["length"], strict=True)), below)
        at = [(pdf["ord"][i], k, pdf["ord"][t]) for t, pieces in found for k, i in enumerate(pieces)]
        return pd.DataFrame(at, columns=["ord", "piece", "target"]).assign(book_id=pdf["book_id"].iloc[0])[["book_id", "ord", "piece", "target"]]

    plan = own.select("book_id", "ord", "section_id", "level", "parent_id", F.length("text").alias("length")).groupBy("book_id").applyInPandas(fold, schema)
    held = own.select("book_id", "ord", "text").join(plan, ["book_id", "ord"]).groupBy("book_id", "target").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"))
    texts = held.select("book_id", F.col("target").alias("ord"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return own.drop("text").join(texts, ["book_id", "ord"]).select("book_id", "ord", "section_id", "level", "parent_id", "text")


def number_in_section(visuals: DataFrame) -> DataFrame:
    """visuals (book_id, section_id, kind, pos) with n, a running number of its kind within the section."""
    order = Window.partitionBy("book_id", "section_id", "kind").orderBy("pos")
    return visuals.withColumn("n", F.row_number().over(order).cast("long"))


def visual_counts(visuals: DataFrame) -> DataFrame:
    """book_id, section_id, n_raster, n_diagram, n_equation."""
    return visuals.groupBy("book_id", "section_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("raster", "diagram", "equation")])


def metadata(sections: DataFrame) -> DataFrame:
    """Without text and visuals; a columnar scan then never reads them."""
    return sections.drop("text", "images", "equations")
