"""Scalar functions against plain Python."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.words import MATH_SYMBOLS, RETRIEVAL_STOP_WORDS, STOP_WORDS


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("title", "slug"),
    [
        ("3.2 Fluid Dynamics", "3-2-fluid-dynamics"),
        ("Chapter 10: Boundary—Layer Theory!!!", "chapter-10-boundarylayer-theory"),
        ("  -- A.B  c --  ", "a-b-c"),
        ("", ""),
        ("é", ""),
        ("x" * 59 + " yz", "x" * 59 + "-"),
    ],
)
def test_slug(spark, title, slug):
    assert one(spark, X.slug, title) == slug


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h", "a\n\n"])
def test_lines(spark, text):
    assert one(spark, X.lines, text) == text.splitlines()


@pytest.mark.parametrize("text", ["\t a \n", "", "\xa0x　", " a\x0b\x1cb ", "\n \t"])
def test_strip(spark, text):
    assert one(spark, X.strip, text) == text.strip()


@pytest.mark.parametrize(("raw", "line"), [(" 12  The\t Title  34 ", "the title"), ("7", ""), ("12 34", ""), ("A 1 B", "a 1 b"), ("2nd Law", "nd law")])
def test_normal_line(spark, raw, line):
    assert one(spark, X.normal_line, raw) == line


def test_strip_html(spark):
    html = "<p>a &amp;lt; b</p>\n\n\n\n<b>c&nbsp;&nbsp; d</b> &#39;&quot;"
    assert one(spark, X.strip_html, html) == "a < b\n\nc d '\""


def test_abstract(spark):
    text = "Short. This sentence says something long! And so does this other one, really? A third one that is long as well."
    assert one(spark, X.abstract, text) == "This sentence says something long! And so does this other one, really?"
    assert one(spark, X.abstract, "tiny. bits. " * 40) == ("tiny. bits. " * 40)[:300]
    assert one(spark, X.abstract, "") == ""


def test_snippet(spark):
    def model(t):
        if len(t) <= 200:
            return t
        cut = t[:200]
        at = cut.rfind(" ")
        return (cut[:at] if at > 150 else cut) + "..."

    for t in ["", "a " * 100, "a " * 101, "b" * 300, "c" * 150 + " " + "d" * 100, "c" * 151 + " " + "d" * 100]:
        assert one(spark, X.snippet, t) == model(t)


def test_short_title(spark):
    assert one(spark, X.short_title, "  one two\tthree four five six seven ") == "one two three four five six…"
    assert one(spark, X.short_title, "one two") == "one two"
    assert one(spark, X.short_title, "") == ""


@pytest.mark.parametrize(("line", "level"), [("3.2.1 Deep", 3), ("3.2 Mid", 2), ("CHAPTER 4", 1), ("part 12", 1), ("4 Title", 1), ("4 title", None), ("3.2 ab", None), ("Chapter", None), ("plain words", None)])
def test_heading_level(spark, line, level):
    assert one(spark, X.heading_level, line) == level


def test_labels(spark):
    assert one(spark, X.equation_label, "x = y (3.14)  ") == "3.14"
    assert one(spark, X.equation_label, "(2-1.3)\n") == "2-1.3"
    assert one(spark, X.equation_label, "(3.14) x") is None
    assert one(spark, X.figure_number, "see FIG. 2.1b here") == "2.1b"
    assert one(spark, X.figure_caption, "Figure 2-1 shows") == "Figure 2-1"
    assert one(spark, X.figure_number, "figure two") is None


def test_final_answer(spark):
    assert one(spark, X.final_answer, "<think>private reasoning</think>Final answer") == "Final answer"
    assert one(spark, X.final_answer, " <think>\nnever ends") is None
    assert one(spark, X.final_answer, "a <think>b</think>") == "a <think>b</think>"


def test_block_fields(spark):
    assert one(spark, X.block_page, "/page/42/Page/1/Text/5") == 42
    assert one(spark, X.block_page, "x") is None
    assert one(spark, X.block_level, "<h3>t</h3>") == 3
    assert one(spark, X.block_level, "<p>t</p>") == 2


def test_names(spark):
    assert one(spark, X.book_name, "Fluid-Mechanics") == "fluid_mechanics"
    assert one(spark, X.display_name, "fluid_mechanics") == "Fluid Mechanics"


def test_page_ranges(spark):
    df = spark.createDataFrame([(0, 0), (3, 5)], "a int, b int").select(X.page_range("a", "b"), X.citation_pages("a", "b"))
    assert [tuple(r) for r in df.collect()] == [("1", "p. 0"), ("4-6", "pp. 3–5")]


def test_tokens_and_grams(spark):
    assert one(spark, X.tokens, "Ab-c é9 x_y") == re.findall("[a-z0-9]+", "ab-c é9 x_y")
    assert one(spark, lambda c: X.grams(X.word_tokens(c)), "Été à la mer x") == ["été", "la", "mer", "été la", "la mer"]
    assert one(spark, lambda c: X.grams(X.word_tokens(c)), "mer") == ["mer"]
    assert one(spark, lambda c: X.grams(X.word_tokens(c)), "") == []


def test_symbols(spark):
    assert one(spark, X.symbol_share, "∑ x = α") == pytest.approx(2 / 4)
    assert one(spark, X.symbol_share, " ") == 0.0
    assert one(spark, X.is_math_font, "ABC+CMMI10") and not one(spark, X.is_math_font, "Times")


def test_lists():
    assert (len(STOP_WORDS), len(RETRIEVAL_STOP_WORDS)) == (276, 318)
    assert len(set(MATH_SYMBOLS)) == len(MATH_SYMBOLS)


def test_long_runs_within_a_line(spark):
    """Runs of digits and blanks that end nowhere near the line's end were tried from each of their places."""
    run = "x" + "7" * 150_000 + "y" + " " * 150_000 + "z 5"
    began = time.perf_counter()
    assert one(spark, X.normal_line, run) == "x" + "7" * 150_000 + "y z"
    assert time.perf_counter() - began < 10
