"""Images, drawings, equations and captions of pages, as tables of rectangles and lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.config import DEFAULTS
from lectern.functions import text as X
from lectern.functions.words import VISUAL_WORDS

#: Rows of a batch of clusters, a page's more at most.
ROWS = 10_000


def first_images(images: DataFrame, least: int = DEFAULTS.min_image_px) -> DataFrame:
    """images (book_id, xref, pos, width, height): the first of each xref in its book, if it's large enough. A small first
    one hides later ones all the same."""
    order = Window.partitionBy("book_id", "xref").orderBy("pos")
    return images.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").where((F.col("width") >= least) & (F.col("height") >= least))


def math_lines(spans: DataFrame, s=DEFAULTS) -> DataFrame:
    """Lines that are mostly set in a mathematical font or rich in mathematical symbols: book_id, page, block, line, text,
    label (an equation number at the end, or null)."""
    chars = F.length(X.strip("text")).cast("long")
    per = spans.groupBy("book_id", "page", "block", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "").alias("text"),
        F.sum(chars).alias("chars"),
        F.sum(F.when(X.is_math_font("font"), chars).otherwise(0)).alias("math_chars"),
    )
    by_font = (F.col("chars") > 0) & (F.col("math_chars") / F.col("chars") > s.math_font_share)
    enough = F.length(F.replace("text", F.lit(" "), F.lit(""))) >= 3
    found = per.where(enough & (F.coalesce(by_font, F.lit(False)) | (X.symbol_share("text") > s.math_symbol_share)))
    return found.select("book_id", "page", "block", "line", "text", X.equation_label("text").alias("label"))


def large_diagrams(clusters: DataFrame, s=DEFAULTS) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return clusters.where((F.col("n_paths") >= s.diagram_min_paths) & (area >= s.diagram_min_area))


def merge_rects(rects: list[tuple[float, float, float, float]], gap: float) -> list[tuple[tuple[float, float, float, float], int]]:
    """Unions of rectangles that come within gap of one another, and how many went into each; a union takes part as its own
    box. Passes run in order until nothing changes."""
    boxes = [(r, 1) for r in rects if r[0] < r[2] and r[1] < r[3]]
    while True:
        out: list = []
        left = boxes
        while left:
            (x0, y0, x1, y1), n = left[0]
            rest = []
            for box in left[1:]:
                (a0, b0, a1, b1), m = box
                if a0 < x1 + gap and x0 - gap < a1 and b0 < y1 + gap and y0 - gap < b1:
                    x0, y0, x1, y1, n = min(x0, a0), min(y0, b0), max(x1, a1), max(y1, b1), n + m
                else:
                    rest.append(box)
            out.append(((x0, y0, x1, y1), n))
            left = rest
        if len(out) == len(boxes):
            return out
        boxes = out


def cluster_rects(rects: DataFrame, gap: float = DEFAULTS.diagram_gap) -> DataFrame:
    """Clusters of a page's drawings: book_id, page, cluster, x0, y0, x1, y1, n_paths. A box grows as it takes others in, so
    this is a fold over a page's rectangles (idx gives their order); pages are dealt out."""
    schema = "book_id string, page int, cluster int, x0 double, y0 double, x1 double, y1 double, n_paths int"
    sides = ("x0", "y0", "x1", "y1")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come page by page; a table a page would cost far more than its fold
        key, page, done = None, [], []

        def close() -> None:
            done.extend((*key, i, *box, n) for i, (box, n) in enumerate(merge_rects(page, gap)))

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*done), arrow)], schema=arrow)

        for batch in batches:
            books, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            boxes = zip(*(batch.column(2 + i).to_numpy(zero_copy_only=False).tolist() for i in range(4)))  # nulls are NaN
            for of, box in zip(zip(books, numbers), boxes):
                if of != key:
                    if page:
                        close()
                    key, page = of, []
                    if len(done) >= ROWS:
                        yield packed()
                        done.clear()
                page.append(box)
        if page:
            close()
        if done:
            yield packed()

    own = rects.select(F.col("book_id").cast("string"), F.col("page").cast("int"), *[F.col(c).cast("double") for c in sides], "idx")
    placed = own.repartition("book_id", "page").sortWithinPartitions("book_id", "page", F.col("idx").asc_nulls_last())
    return placed.select("book_id", "page", *sides).mapInArrow(run, schema)


def nearest_caption(regions: DataFrame, text_lines: DataFrame, within: float = DEFAULTS.caption_distance) -> DataFrame:
    """regions (book_id, page, cluster, y0, y1) with caption: the first line of the page with a figure number in a block at
    most ``within`` above or below. Lines: book_id, page, pos, text, y0, y1 of their block.

    Only lines with a figure number are joined, by page."""
    captions = text_lines.select("book_id", "page", "pos", F.col("y0").alias("ly0"), F.col("y1").alias("ly1"), X.figure_caption("text").alias("caption")).where("caption is not null")
    near = F.least(F.abs(F.col("ly0") - F.col("y1")), F.abs(F.col("y0") - F.col("ly1"))) <= within
    best = regions.join(captions, ["book_id", "page"]).where(near).groupBy("book_id", "page", "cluster").agg(F.min_by("caption", "pos").alias("caption"))
    return regions.join(best, ["book_id", "page", "cluster"], "left")


def computational(question: str | Column) -> Column:
    return F.lower(X.col(question)).rlike(X.COMPUTATIONAL)


def select_visuals(visuals: DataFrame, n: int = DEFAULTS.max_visuals, max_bytes: int = DEFAULTS.max_visual_bytes) -> DataFrame:
    """Of each question's visuals (q_id, question, section_pos, kind, pos, size) the first n that aren't too large; equations
    come first where the question asks for a computation."""
    late = F.when(computational("question"), (F.col("kind") != "equation").cast("int")).otherwise(0)
    order = Window.partitionBy("q_id").orderBy(late, "section_pos", F.when(F.col("kind") == "equation", 1).otherwise(0), "pos")
    return visuals.where(F.col("size") <= max_bytes).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def has_visuals(images: str | Column = "images", equations: str | Column = "equations") -> Column:
    return (F.coalesce(F.size(X.col(images)), F.lit(0)) > 0) | (F.coalesce(F.size(X.col(equations)), F.lit(0)) > 0)


def attachment(question: str | Column, held: Column) -> Column:
    """attach, has_visuals (held) and asks_for_visuals as a struct. What is there goes along whatever the question says; that
    the question asks for it is kept to explain the choice."""
    asks = F.lower(X.col(question)).rlike(X.any_of(VISUAL_WORDS))
    return F.struct(held.alias("attach"), held.alias("has_visuals"), F.coalesce(asks, F.lit(False)).alias("asks_for_visuals"))


def entries(sections: DataFrame) -> DataFrame:
    """section_id, kind, pos, path of the visuals of sections (section_id, images, equations): figures, then equations. Each
    section is read once; null arrays hold nothing."""

    def tagged(kind: str, c: str) -> Column:
        return F.coalesce(F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["path"].alias("path"))), F.array())

    return sections.select("section_id", F.explode(F.concat(tagged("figure", "images"), tagged("equation", "equations"))).alias("v")).select("section_id", "v.*")
