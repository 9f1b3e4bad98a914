"""Pages to answers, with a stub for the model."""

import json
import re

from pyspark.sql import functions as F

from lectern import book
from lectern.config import Settings

FILLER = "Electric current flows through the resistor network while voltage drops across every element. " * 4


def kept(df):
    """Written and read again, as between the steps of a run."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def pages(spark):
    texts = ["Header 1\nChapter 1 Basics\n" + FILLER, "Header 2\n1.1 Ohm Law\nOhm resistance conductor ohm resistance. " + FILLER, "Header 3\n1.2 Tiny\nx", "Header 4\nChapter 2 Magnets\nMagnet field coil magnet. " + FILLER, "Header 5\n2.1 Coils\nCoil winding inductance coil. " + FILLER]
    return spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book_id string, page int, text string")


def test_book(spark):
    p = pages(spark)
    toc = kept(book.outline_of(p))
    assert [(r.level, r.title, r.start_page) for r in toc.orderBy("toc_idx").collect()] == [(1, "Chapter 1 Basics", 0), (2, "1.1 Ohm Law", 1), (2, "1.2 Tiny", 2), (1, "Chapter 2 Magnets", 3), (2, "2.1 Coils", 4)]
    secs = kept(book.split(p, toc))
    got = {r.section_id: r for r in secs.collect()}
    assert sorted(got) == ["1-1-ohm-law", "2-1-coils", "chapter-1-basics", "chapter-2-magnets"]
    assert got["1-1-ohm-law"].parent_id == "chapter-1-basics" and got["chapter-1-basics"].text.startswith("1.2 Tiny\nx\nChapter 1")
    assert "Header" not in "".join(r.text for r in got.values())
    built = book.index(secs)
    built = book.Index(kept(built.nodes), kept(built.candidates), kept(built.confusable))
    cands = {r.section_id: r for r in built.candidates.collect()}
    assert cands["2-1-coils"].chapter_title == "Chapter 2 Magnets" and "coil" in cands["2-1-coils"].tfidf_keywords
    questions = spark.createDataFrame([("q1", "What is ohm resistance?"), ("q2", "fail")], "q_id string, question string")

    def make():
        def model(prompt):
            if "Question: fail" in prompt:
                raise TimeoutError
            if prompt.startswith("Choose"):
                return "```json\n" + json.dumps({"sections": [{"section_id": re.search(r"\[(1-1[^\]]*)\]", prompt)[1]}, {"section_id": "unknown"}]}) + "\n```"
            return "<think>hm</think>By Ohm's law."

        return model

    routed = kept(book.route(built, questions, make, "b"))
    assert [(r.q_id, r.rank, r.section_id, r.title) for r in routed.collect()] == [("q1", 1, "1-1-ohm-law", "1.1 Ohm Law")]
    told = {r.q_id: r.answer for r in book.respond(routed, questions, secs, make).collect()}
    assert told["q1"] == "By Ohm's law.\n\n---\n📖 **Sources:**\n- §1.1 Ohm Law (p. 1) · id: `1-1-ohm-law`"
    assert told["q2"].startswith("No section")

    shown = spark.createDataFrame([("1-1-ohm-law", "raster", 0, 10, "data:a"), ("1-1-ohm-law", "equation", 1, 10, "data:b"), ("1-1-ohm-law", "raster", 2, 10**9, "data:c"), ("other", "raster", 0, 10, "data:d")], "section_id string, kind string, pos int, size long, url string")
    looks = lambda: lambda prompt, images=(): " ".join(images) or "none"
    asked = questions.withColumn("question", F.when(F.col("q_id") == "q1", "Derive ohm resistance").otherwise(F.col("question")))
    assert {r.q_id: r.answer for r in book.respond(routed, asked, secs, looks, Settings(max_visuals=2), shown).collect()}["q1"].startswith("data:b data:a\n")
    assert {r.q_id: r.answer for r in book.respond(routed, questions, secs, looks, pictures=shown.where("section_id = 'other'")).collect()}["q1"].startswith("none\n")


def test_blocks(spark):
    tree = {"children": [{"block_type": "SectionHeader", "id": "/page/0/a", "html": "<h1>One</h1>"}, {"block_type": "Text", "id": "/page/1/a", "html": "<p>body</p>"}, {"block_type": "SectionHeader", "id": "/page/2/a", "html": "<h2>Sub</h2>"}, {"block_type": "Figure", "id": "/page/2/b"}]}
    secs = kept(book.split_blocks(spark.createDataFrame([("b", 0, json.dumps(tree))], "book_id string, part int, json string")))
    got = {r.section_id: r for r in secs.collect()}
    assert (got["sub"].parent_id, got["sub"].chapter, got["one"].end_page, got["sub"].n_images) == ("one", "One", 2, 1)
    assert {r.section_id: r.has_visuals for r in book.index(secs).candidates.collect()} == {"one": False, "sub": True}
