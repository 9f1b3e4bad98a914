"""Routing a question: the catalogue for a model, its answer parsed and checked, picks enriched, confusable siblings missed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULTS
from lectern.functions import text as X

_PICKS = "array<struct<section_id:string,confidence:string,reason:string>>"


class Model(Protocol):
    """Any model; None stands for a failed call. images (data URLs) are given only where there are some, so a model of texts
    needn't take them."""

    def __call__(self, prompt: str, images: list[str] = ...) -> str | None: ...


def ask(prompts: DataFrame, make_model: Callable[[], Model], prompt: str = "prompt", answer: str = "answer", images: str | None = None) -> DataFrame:
    """prompts with the model's answer; a failed call gives null. The client is made once a task. images: a column of arrays
    of data URLs that go with a prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def one(p, urls):
            try:
                return model(p, list(urls)) if urls is not None and len(urls) else model(p)
            except Exception:  # noqa: BLE001  an answer that can't be had is null, whatever the client raises
                return None

        for pdf in batches:
            seen = pdf[images] if images else [None] * len(pdf)
            yield pdf.assign(**{answer: [one(p, urls) for p, urls in zip(pdf[prompt], seen, strict=True)]})

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField(answer, T.StringType())]))


def catalog_entry(section_id="section_id", title="title", chapter="chapter_title", abstract="abstract", keywords="tfidf_keywords", supplementary="is_deprioritized") -> Column:
    """A candidate as a model reads it."""
    head = F.concat(F.lit("["), F.col(section_id).cast("string"), F.lit("] Chapter: "), chapter, F.lit(" | "), title, F.when(F.col(supplementary), " [SUPPLEMENTARY]").otherwise(""))
    kw = F.array_join(F.slice(keywords, 1, 10), ", ")
    return F.concat(head, F.lit("\n  Abstract: "), X.snippet(F.coalesce(F.col(abstract), F.lit(""))), F.when(kw != "", F.concat(F.lit("\n  Keywords: "), kw)).otherwise(""), F.lit("\n"))


_RULES = """Choose up to {k} sections of this catalogue that answer the question, the most useful one first.
- Go by what a section is about, even where its title has none of the question's words.
- Where the question compares things or joins several topics, take a section for each of them.
- Where two neighbouring sections may both be meant, take both with confidence medium; one too many is better than the right one missed.
- Take sections marked [SUPPLEMENTARY] only where exercises, summaries or history are asked for.

For "How does a heap keep its order?": {{"sections": [{{"section_id": "6-2-heap-order", "confidence": "high", "reason": "It shows how sifting restores the order."}}]}}
For "Heaps or search trees for a schedule?": {{"sections": [{{"section_id": "6-2-heap-order", "confidence": "high", "reason": "Heaps as queues."}}, {{"section_id": "7-1-search-trees", "confidence": "high", "reason": "Trees for the same task."}}]}}

Question: """


def prompts(questions: DataFrame, shortlisted: DataFrame, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """q_id, prompt from questions (q_id, question) and their shortlisted candidates (q_id, rank, entry)."""
    catalog = shortlisted.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("c"))
    text = F.concat(
        F.lit(_RULES.format(k=top_k)),
        F.col("question"),
        F.lit("\n\nCatalogue:\n"),
        F.array_join(F.transform("c", lambda x: x["entry"]), "\n"),
        F.lit('\n\nReply with JSON alone: {"sections": [{"section_id": "...", "confidence": "high|medium|low", "reason": "..."}]}'),
    )
    return questions.join(catalog, "q_id").select("q_id", text.alias("prompt"))


def parse_picks(raw: str | Column) -> Column:
    """A model's answer to an array of picks: an object with "sections" or a bare list, in a code fence or within other
    words. Entries without a section_id go; confidence is "unknown" and reason empty where they're missing. Anything else
    gives no picks."""
    clean = X.unfence(raw)
    whole, salvaged = F.from_json(clean, f"sections {_PICKS}")["sections"], F.from_json(X.braces(clean), f"sections {_PICKS}")["sections"]
    bare = F.when(clean.startswith("["), F.from_json(clean, _PICKS))
    found = F.filter(F.coalesce(bare, whole, salvaged, F.array().cast(_PICKS)), lambda p: p["section_id"].isNotNull())
    return F.transform(found, lambda p: F.struct(p["section_id"].alias("section_id"), F.coalesce(p["confidence"], F.lit("unknown")).alias("confidence"), F.coalesce(p["reason"], F.lit("")).alias("reason")))


def parse_abstract(raw: str | Column, text: str | Column) -> Column:
    """A model's description of a section in one line: description, key concepts and example questions, as far as its JSON
    gives them; its own words if they're no JSON; the text's own abstract if there was no answer."""
    found = F.from_json(X.unfence(raw), "description string, concepts array<string>, example_questions array<string>")
    none = found["description"].isNull() & found["concepts"].isNull() & found["example_questions"].isNull()
    part = lambda name, items, n, sep: F.when(F.size(items) > 0, F.concat(F.lit(name), F.array_join(F.slice(items, 1, n), sep)))
    told = F.concat_ws(" | ", F.coalesce(found["description"], F.lit("")), part("Key concepts: ", found["concepts"], 10, ", "), part("Example questions: ", found["example_questions"], 2, "; "))
    return F.when(F.coalesce(X.col(raw), F.lit("")) == "", X.abstract(text)).when(none, X.col(raw)).otherwise(told)


def abstracts(sections: DataFrame, make_model: Callable[[], Model], first: int = 2000) -> DataFrame:
    """sections (title, chapter, text and others) with abstract, from a model that reads the first characters of each."""
    prompt = F.concat(
        F.lit("Describe this section of a textbook for a study aid.\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nChapter: "), F.coalesce("chapter", F.lit("")), F.lit("\n\n"), F.substring("text", 1, first),
        F.lit('\n\nReply with JSON alone: {"description": "two or three sentences", "concepts": ["five to ten terms"], "example_questions": ["two questions"]}'),
    )
    asked = ask(sections.withColumn("_prompt", prompt), make_model, "_prompt", "_answer")
    return asked.withColumn("abstract", parse_abstract("_answer", "text")).drop("_prompt", "_answer")


def enrich(answers: DataFrame, candidates: DataFrame, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """answers (q_id, picks) to a row a pick that is a candidate, with the candidate's columns. The cut to top_k comes first,
    so unknown ids leave fewer; a repeated pick stays."""
    flat = answers.select("q_id", F.posexplode(F.slice("picks", 1, top_k)).alias("pos", "pick")).select("q_id", (F.col("pos") + 1).cast("long").alias("rank"), "pick.*")
    return flat.join(candidates, "section_id")


def missed_siblings(results: DataFrame, siblings: DataFrame) -> DataFrame:
    """q_id, section_id, missed: siblings of the first pick that easily pass for it and weren't picked."""
    picked = results.groupBy("q_id").agg(F.collect_set("section_id").alias("ids"))
    first = results.where("rank = 1").select("q_id", "section_id").join(siblings, "section_id")
    out = first.join(picked, "q_id").select("q_id", "section_id", F.array_except("siblings", "ids").alias("missed"))
    return out.where(F.size("missed") > 0)
