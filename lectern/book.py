"""The whole way: pages to sections, sections to an index, questions to picks and answers. Each step takes and returns
DataFrames for any number of books; materialise (write, or checkpoint) between steps where a result is used again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, Settings
from lectern.functions import text as X
from lectern.operators import answer, blocks, keywords, outline, retrieval, routing, sections, visuals


def outline_of(pages: DataFrame, bookmarks: DataFrame | None = None, spans: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """book_id, toc_idx, level, title, start_page: bookmarks (with ord) where a book has enough, else headings by font, else
    by wording. A book without any has no rows."""
    by_words = outline.regex_headings(pages).select("book_id", "level", "title", F.col("page").alias("start_page"), "line")
    tiers = []
    if bookmarks is not None:
        tiers.append((bookmarks.select("book_id", "level", "title", F.greatest("start_page", F.lit(0)).alias("start_page"), F.col("ord").cast("long").alias("ord")), s.min_bookmarks))
    if spans is not None:
        fonts = outline.font_headings(spans, s)
        tiers.append((fonts.select("book_id", "level", "title", F.col("page").alias("start_page"), (F.col("block").cast("long") * 1_000_000 + F.col("line")).alias("ord")), s.min_headings))
    tiers.append((by_words.withColumn("ord", F.col("line").cast("long")).drop("line"), 1))
    return outline.first_outline(*tiers)


def split(pages: DataFrame, toc: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Sections of books with a text layer: repeated margins stripped, texts by page range, tiny sections merged.

    book_id, ord, section_id, title, level, chapter, parent_id, start_page, end_page, text.
    """
    last = pages.groupBy("book_id").agg(F.max("page").alias("last_page"))
    entries = outline.chapters(outline.parents(outline.unique_slugs(outline.page_ranges(toc, last))))
    ids = entries.select("book_id", F.col("toc_idx").alias("parent_idx"), F.col("section_id").alias("parent_id"))
    entries = entries.join(ids, ["book_id", "parent_idx"], "left").drop("parent_idx")
    clean = sections.strip_repeating(pages, sections.repeating_lines(pages, s.repeat_ratio, s.margin_lines, s.repeat_min_pages))
    texts = entries.join(sections.range_text(entries, clean), ["book_id", "toc_idx"], "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("ord", F.col("toc_idx").cast("long"))
    merged = sections.merge_tiny(texts, s.tiny_section_chars).select("book_id", "ord", "text")
    return merged.join(texts.drop("text", "toc_idx"), ["book_id", "ord"]).select("book_id", "ord", "section_id", "title", "level", "chapter", "parent_id", "start_page", "end_page", "text")


def split_blocks(trees: DataFrame) -> DataFrame:
    """Sections of recognised books (block trees as blocks.flatten takes them), as split() returns them, and their numbers
    of images and equations. Tiny sections stay."""
    own = blocks.sectionize(blocks.read_blocks(blocks.flatten(trees))).withColumn("toc_idx", F.col("section_no").cast("int"))
    named = outline.unique_slugs(outline.chapters(outline.parents(own), own_counts=True), empty="untitled")
    ids = named.select("book_id", F.col("toc_idx").alias("parent_idx"), F.col("section_id").alias("parent_id"))
    return named.join(ids, ["book_id", "parent_idx"], "left").select("book_id", F.col("section_no").alias("ord"), "section_id", "title", "level", "chapter", "parent_id", "start_page", "end_page", "text", "n_images", "n_equations")


@dataclass(frozen=True)
class Index:
    """nodes of all sections, candidates that can be routed to, pairs that are easily confused."""

    nodes: DataFrame
    candidates: DataFrame
    confusable: DataFrame


def index(secs: DataFrame, s: Settings = DEFAULTS, depth: int = 6) -> Index:
    """secs as split() returns them; images and equations are taken into account where they're there."""
    sets = keywords.keyword_sets(secs.select("book_id", "section_id", "text"), s.top_keywords)
    seen = visuals.has_visuals() if {"images", "equations"} <= {*secs.columns} else (F.col("n_images") + F.col("n_equations") > 0) if "n_images" in secs.columns else F.lit(False)
    nodes = secs.join(sets, ["book_id", "section_id"]).select(
        "book_id", F.col("section_id").alias("node_id"), "parent_id", F.col("ord").cast("int").alias("ord"), "title", X.page_range("start_page", "end_page").alias("page_range"),
        "keywords", "tfidf_keywords", "all_keywords", X.abstract("text").alias("abstract"), seen.alias("has_visuals"),
    )
    tree = secs.select("book_id", F.col("section_id").alias("node_id"), "parent_id", F.col("ord").cast("int").alias("ord"), "title")
    flat = outline.flatten(tree, depth)
    details = nodes.select("book_id", "node_id", "page_range", "keywords", "tfidf_keywords", "abstract", "has_visuals")
    candidates = flat.join(details, ["book_id", "node_id"]).withColumnRenamed("node_id", "section_id")
    siblings = outline.roots(tree).join(sets.withColumnRenamed("section_id", "node_id"), ["book_id", "node_id"]).select("book_id", F.col("node_id").alias("section_id"), "all_keywords", F.struct("book_id", F.when(F.col("is_root"), None).otherwise(F.col("parent_id")).alias("parent")).alias("siblings"))
    return Index(nodes.drop("all_keywords"), candidates, keywords.confusable_pairs(siblings, s.confusable_overlap, group="siblings"))


def route(built: Index, questions: DataFrame, make_model: Callable[[], routing.Model], book_id: str, s: Settings = DEFAULTS) -> DataFrame:
    """questions (q_id, question) of a book to picks in order: q_id, rank, section_id, confidence, reason and the candidate's
    columns. Stage one cuts the candidates down to a shortlist, a model picks from it; a failed call gives no picks."""
    own = built.candidates.where(F.col("book_id") == book_id)
    texts = own.select("section_id", retrieval.candidate_text().alias("text"))
    listed = retrieval.shortlist(texts, questions.select("q_id", F.col("question").alias("text")), "section_id", "q_id", s.shortlist, max_features=s.max_features)
    entries = listed.join(own.select("section_id", routing.catalog_entry().alias("entry")), "section_id")
    asked = routing.ask(routing.prompts(questions, entries, s.top_k), make_model)
    return routing.enrich(asked.select("q_id", routing.parse_picks("answer").alias("picks")), own, s.top_k)


def respond(routed: DataFrame, questions: DataFrame, secs: DataFrame, make_model: Callable[[], routing.Model], s: Settings = DEFAULTS, pictures: DataFrame | None = None) -> DataFrame:
    """q_id, answer with its sources: sections packed under the budget, a model's answer without its thinking. Questions
    without picks, and failed calls, get a sentence that says so. pictures (section_id, kind, pos, size, url) of the sections
    go to the model with the texts."""
    texts = routed.select("q_id", F.col("rank").alias("pos"), "section_id").join(secs.select("section_id", "text"), "section_id")
    prompts = answer.answer_prompts(questions, answer.pack_context(texts, s.context_chars), secs.select("section_id", "chapter", "title"))
    if pictures is not None:
        prompts = prompts.join(answer.attached(questions, routed, pictures, s.max_visuals), "q_id", "left")
    asked = routing.ask(prompts, make_model, images=None if pictures is None else "images")
    footers = answer.citation_footer(routed.select("q_id", F.col("rank").alias("pos"), "section_id"), secs)
    told = asked.select("q_id", X.final_answer("answer").alias("told")).join(footers, "q_id", "left")
    out = questions.select("q_id").join(told, "q_id", "left").join(routed.select("q_id").distinct().withColumn("any", F.lit(True)), "q_id", "left")
    text = F.when(F.col("any").isNull(), "No section of this book fits the question.").when(F.col("told").isNull(), "No answer could be had just now.").otherwise(answer.with_footer("told", "footer"))
    return out.select("q_id", text.alias("answer"))
