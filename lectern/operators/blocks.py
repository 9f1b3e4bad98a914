"""Recognised layout blocks: flattening their trees, grouping them into sections."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

TEXT = ("Text", "TextInlineMath", "ListItem", "ListGroup", "Caption", "Footnote", "Code")
IMAGES = ("Picture", "Figure")
FLAT = "book_id string, seq long, block_type string, id string, html string, heading_level int, n_images int"


def walk(node) -> Iterator[dict]:
    """Blocks of a tree in document order: a parent, then its children. Nodes without a type are passed through."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            if x.get("block_type", x.get("type", "")):
                yield x
            if kids := x.get("children"):
                todo.append(kids)


def flatten(trees: DataFrame) -> DataFrame:
    """trees (book_id, part, json) to a row a block. Field names and depth vary, so this parses in Python, a text at a time;
    parts of a book are numbered apart (seq = part * 2**32 + place) so that a book may come in any number of pieces.
    Broken JSON gives no rows.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for book, part, raw in zip(pdf["book_id"], pdf["part"], pdf["json"], strict=True):
                try:
                    tree = json.loads(raw) if raw else []
                except ValueError:
                    continue
                for i, b in enumerate(walk(tree)):
                    level = b.get("heading_level")
                    rows.append((book, (int(part) << 32) + i, b.get("block_type", b.get("type", "")), b.get("id", ""), b.get("html", ""), level if isinstance(level, int) else None, len(b.get("images") or {})))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FLAT.split(", ")]).astype({"heading_level": "Int32"})

    return trees.select("book_id", "part", "json").mapInPandas(run, FLAT)


def sectionize(blocks: DataFrame) -> DataFrame:
    """Sections of blocks (book_id, seq, block_type, page, title, level, text): a header opens one; what comes before the
    first is "Front Matter" and is left out where it's empty. text is a header's wording or a block's text.

    One row a section: book_id, section_no, title, level, start_page, end_page, text, n_images, n_equations. The last page
    is the largest of its blocks of any type, and the next header's, as its page is seen before the section closes. A header
    without a page starts where the section before it ended.
    """
    header = F.col("block_type") == "SectionHeader"
    upto = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = blocks.withColumn("section_no", F.count_if(header).over(upto))
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    kind = F.col("block_type")
    body = F.when(kind.isin(*TEXT, "Equation") & has_text, F.col("text")).when((kind == "Table") & has_text, F.concat(F.lit("\n[Table]\n"), "text", F.lit("\n")))
    per = numbered.groupBy("book_id", "section_no").agg(
        F.min_by("text", "seq").alias("first_text"),
        F.min_by("level", "seq").alias("first_level"),
        F.min_by("page", "seq").alias("head_page"),
        F.max("page").alias("max_page"),
        F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("seq", body.alias("t"))))).alias("parts"),
        F.count_if(kind.isin(*IMAGES)).alias("n_images"),
        F.count_if(kind == "Equation").alias("n_equations"),
    )
    order = Window.partitionBy("book_id").orderBy("section_no")
    front = F.col("section_no") == 0
    # the run of pages that reaches a header without one: all that came since the last header with a page
    head = F.when(front, 0).otherwise(F.col("head_page"))
    anchors = per.withColumn("head", head).withColumn("run", F.count("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("book_id", "run").orderBy("section_no")
    here = F.coalesce(F.max("max_page").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = anchors.withColumn("start_page", F.coalesce("head", F.greatest(here, F.first("head", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))))
    end = F.greatest("start_page", "max_page", F.coalesce(F.lead("head_page").over(order), F.col("start_page")))
    text = X.strip(F.array_join(F.transform("parts", lambda x: x["t"]), "\n"))
    out = started.select(
        "book_id", "section_no",
        F.when(front, F.lit("Front Matter")).otherwise(F.col("first_text")).alias("title"),
        F.when(front, 1).otherwise(F.col("first_level")).alias("level"),
        "start_page", end.alias("end_page"), text.alias("text"), "n_images", "n_equations",
    )
    return out.where("not (title = 'Front Matter' and text = '' and n_images = 0 and n_equations = 0)")


def read_blocks(flat: DataFrame) -> DataFrame:
    """Flattened blocks with page, level and text, as sectionize takes them."""
    return flat.select("book_id", "seq", "block_type", X.block_page("id").alias("page"), X.block_level("html", "heading_level").alias("level"), X.strip_html("html").alias("text"))


def image_names(files: DataFrame) -> DataFrame:
    """files (book_id, part, name) of the recognised parts of books, with file: the name that each has once parts are put
    together. The first part keeps a name, later ones put part_<n>_ before it; hidden files are left out."""
    order = Window.partitionBy("book_id", "name").orderBy("part")
    seen = files.where(~F.col("name").startswith(".")).withColumn("n", F.row_number().over(order))
    return seen.withColumn("file", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(F.lit("part_"), "part", F.lit("_"), "name"))).drop("n")
