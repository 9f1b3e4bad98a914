"""Grounded answers: context under a budget, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions import text as X
from lectern.operators import visuals

_BLOCKS = "array<struct<pos:bigint,section_id:string,text:string>>"


def pack_context(routed: DataFrame, budget: int = DEFAULTS.context_chars) -> DataFrame:
    """routed (q_id, pos, section_id, text) to q_id, pos, section_id, text of what fits ``budget`` characters.

    Sections come in order. One that is too long is cut to what remains, back to its last blank, and "..." is put after it;
    packing ends when nothing remains. What remains shrinks by the text as cut, so each step depends on the one before:
    a fold over the few sections of one question.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("section_id").cast("string").alias("section_id"), X.strip(F.coalesce("text", F.lit(""))).alias("text"))))

    def step(acc: Column, x: Column) -> Column:
        head = F.substring(x["text"], F.lit(1), acc["left"])
        blank = F.length(head) - F.instr(F.reverse(head), " ")
        cut = F.concat(F.when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), blank)).otherwise(head), F.lit("..."))
        text = F.when(F.length(x["text"]) > acc["left"], cut).otherwise(x["text"])
        block = F.struct(x["pos"].alias("pos"), x["section_id"].alias("section_id"), text.alias("text"))
        taken = F.struct((acc["left"] - F.length(text)).cast("int").alias("left"), F.concat(acc["blocks"], F.array(block)).alias("blocks"))
        return F.when(acc["left"] > 0, taken).otherwise(acc)

    start = F.struct(F.lit(budget).cast("int").alias("left"), F.array().cast(_BLOCKS).alias("blocks"))
    packed = routed.groupBy("q_id").agg(ordered.alias("r")).select("q_id", F.aggregate("r", start, step, lambda acc: acc["blocks"]).alias("b"))
    return packed.select("q_id", F.explode("b").alias("b")).select("q_id", "b.*")


def answer_prompts(questions: DataFrame, packed: DataFrame, headings: DataFrame) -> DataFrame:
    """q_id, prompt: the packed sections under their headings (section_id, chapter, title) and the question."""
    block = F.concat(F.lit("[Section: "), F.coalesce("chapter", F.lit("")), F.lit(" -> "), F.coalesce("title", F.lit("")), F.lit("]\n"), "text")
    held = packed.join(headings, "section_id").groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("t")))).alias("c"))
    text = F.concat(
        F.lit("Answer from the sections below alone, for someone who prepares for an examination: idea, mechanism or derivation, then a short example of theirs. Say so where they don't answer.\n\nQuestion: "),
        F.col("question"),
        F.lit("\n\nSections:\n"),
        F.array_join(F.transform("c", lambda x: x["t"]), "\n\n---\n\n"),
    )
    return questions.join(held, "q_id").select("q_id", text.alias("prompt"))


def attached(questions: DataFrame, routed: DataFrame, pictures: DataFrame, n: int = DEFAULTS.max_visuals) -> DataFrame:
    """q_id, images: the data URLs that go with a question's sections, at most n. pictures: section_id, kind, pos, size, url."""
    own = routed.select("q_id", F.col("rank").alias("section_pos"), "section_id").join(pictures, "section_id").join(questions, "q_id")
    chosen = visuals.select_visuals(own, n).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("u"))
    return chosen.select("q_id", F.transform("u", lambda x: x["url"]).alias("images"))


def citation_footer(cited: DataFrame, sections: DataFrame) -> DataFrame:
    """cited (q_id, pos, section_id) to q_id, footer: a line a section that still exists, in order; no row without any."""
    line = F.concat(F.lit("- §"), "title", F.lit(" ("), X.citation_pages("start_page", "end_page"), F.lit(") · id: `"), F.col("section_id").cast("string"), F.lit("`"))
    held = cited.join(sections.select("section_id", line.alias("line")), "section_id")
    joined = held.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return joined.select("q_id", F.concat(F.lit("---\n📖 **Sources:**\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("footer"))


def with_footer(answer: str | Column, footer: str | Column) -> Column:
    return F.concat_ws("\n\n", X.col(answer), F.nullif(X.col(footer), F.lit("")))
