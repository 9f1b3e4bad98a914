"""Column functions on text. Built-in expressions only, so all of them run inside the JVM.

White space is the Unicode set, spelled out, because \\s is ASCII in Java's regular expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.words import MATH_FONTS, MATH_SYMBOLS, STOP_WORDS

_SP = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, NOT_SPACE = f"[{_SP}]", f"[^{_SP}]"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]"
#: The same for Java, in forms that ask one or two questions of most characters; the ones above are what SQL uses.
_LATIN, _WIDE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0", r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
_RUNS = rf"[\x20{_LATIN}{_WIDE}]{{2,}}|[{_LATIN}{_WIDE}]"
_LINE_END = r"[\n\r\x0b\f\x1c\x1d\x1e\x85[\x{2028}-\x{2029}]](?:(?<=\r)\n)?"
_SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: (pattern, level); the first match decides. Fixed values.
HEADINGS = (
    (rf"^\d+\.\d+\.\d+{SPACE}+", 3),
    (rf"^\d+\.\d+{SPACE}+", 2),
    (rf"(?i)^chapter{SPACE}+\d+", 1),
    (rf"(?i)^part{SPACE}+\d+", 1),
    (rf"^\d+{SPACE}+[A-Z]", 1),
)
EQUATION_NUMBER = rf"\((\d+[.\-]\d+(?:[.\-]\d+)?)\){SPACE}*\z"
FIGURE_CAPTION = rf"(?i)(?:figure|fig\.?){SPACE}*(\d+[.\-]\d+[a-z]?)"
SUPPLEMENTARY = rf"(?i)summary|bibliographical{SPACE}+and{SPACE}+historical{SPACE}+notes|exercises|problems"
#: In this order: a doubly escaped entity is decoded twice.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
COMPUTATIONAL = "equation|derive|calculate|solve"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space at either end. Only the ends are looked at, where a regular expression would try every place."""
    return F.btrim(col(c), F.lit(_SPACES))


def squeeze(c: str | Column) -> Column:
    """Each run of white space as one blank. Blanks that stand alone are left as they are, so most are not written anew."""
    return F.regexp_replace(col(c), _RUNS, " ")


def bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def lines(c: str | Column) -> Column:
    """Lines of a text as an array; a final line end opens no further line, an empty text has none."""
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return bound(F.split(col(c), _LINE_END, -1), whole)


def tokens(c: str | Column) -> Column:
    """ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def is_keyword(term: str | Column, stop_words=STOP_WORDS) -> Column:
    t = col(term)
    return (F.length(t) >= 3) & ~t.rlike(r"\A[0-9]+\z") & ~t.isin(*sorted(stop_words))


def word_tokens(c: str | Column) -> Column:
    """Runs of two or more letters, digits or underscores of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def grams(words: Column) -> Column:
    """Single words, then neighbours joined by a blank."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def slug(c: str | Column, longest: int = 60) -> Column:
    s = F.regexp_replace(F.lower(col(c)), rf"(?:{SPACE}|\.)+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]", ""), "-{2,}", "-")
    return F.substring(F.regexp_replace(s, r"^-+|-+\z", ""), 1, longest)


def normal_line(c: str | Column) -> Column:
    """A line without page numbers at its ends, in one case and spacing."""
    # both ends by patterns that can match at the beginning only, so a long line costs no more than a short one
    number = r"\A\p{Nd}+"
    s = F.regexp_replace(strip(c), rf"{number}{SPACE}*", "")
    s = F.when(F.right(s, F.lit(1)).rlike(number), F.reverse(F.regexp_replace(F.reverse(s), rf"{number}{SPACE}*", ""))).otherwise(s)
    return F.lower(strip(squeeze(s)))


def strip_html(c: str | Column) -> Column:
    """Text between tags, six entities decoded, blanks squeezed, at most one empty line in a row."""
    s = F.regexp_replace(col(c), "<[^>]+>", "")
    for entity, plain in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(plain))
    return strip(F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), "\n{3,}", "\n\n"))


def sentences(c: str | Column) -> Column:
    return F.split(col(c), rf"(?<=[.!?]){SPACE}+")


def abstract(c: str | Column, n: int = 2, longer_than: int = 20, fallback: int = 300) -> Column:
    """The first sentences that say something, else the beginning of the text."""
    told = F.slice(F.filter(sentences(strip(c)), lambda s: F.length(s) > longer_than), 1, n)
    return F.when(F.size(told) > 0, F.array_join(told, " ")).otherwise(F.substring(col(c), 1, fallback))


def snippet(c: str | Column, longest: int = 200, at_least: int = 150) -> Column:
    """Cut at a blank where there's a late one."""
    head = F.substring(col(c), 1, longest)
    blank = F.length(head) - F.instr(F.reverse(head), " ")  # index from 0 of the last blank
    shorter = F.when((F.instr(head, " ") > 0) & (blank > at_least), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(col(c)) > longest, F.concat(shorter, F.lit("..."))).otherwise(col(c))


def short_title(question: str | Column, words: int = 6) -> Column:
    parts = F.filter(F.split(strip(question), f"{SPACE}+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, "…").otherwise(""))


def heading_level(line: str | Column) -> Column:
    """Level of a numbered or named heading; null for other lines and for those with under three characters of text."""
    c, level = strip(line), F.lit(None).cast("int")
    for pattern, at in reversed(HEADINGS):
        level = F.when(c.rlike(pattern), at).otherwise(level)
    return F.when(F.length(F.regexp_replace(c, rf"(?:{SPACE}|[\d.\-:])", "")) >= 3, level)


def equation_label(line: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(line), EQUATION_NUMBER, 1), F.lit(""))


def figure_number(line: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(line), FIGURE_CAPTION, 1), F.lit(""))


def figure_caption(line: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(line), FIGURE_CAPTION, 0), F.lit(""))


def symbol_share(c: str | Column) -> Column:
    """Share of mathematical symbols among characters other than blanks; 0 for none."""
    s = F.replace(col(c), F.lit(" "), F.lit(""))
    n = F.length(s) - F.length(F.translate(s, MATH_SYMBOLS, ""))
    return F.when(F.length(s) > 0, n / F.length(s)).otherwise(0.0)


def is_math_font(font: str | Column) -> Column:
    return F.lower(col(font)).rlike("|".join(MATH_FONTS))


def page_range(first: str | Column, last: str | Column) -> Column:
    """Pages counted from 1: "a-b", or "a" alone."""
    a, b = col(first), col(last)
    return F.when(a != b, F.concat_ws("-", a + 1, b + 1)).otherwise((a + 1).cast("string"))


def citation_pages(first: str | Column, last: str | Column) -> Column:
    """Pages counted from 0, as citations print them."""
    a, b = col(first), col(last)
    return F.when(a == b, F.concat(F.lit("p. "), a)).otherwise(F.concat(F.lit("pp. "), a, F.lit("–"), b))


def block_page(block_id: str | Column) -> Column:
    return F.expr("try_cast(null as int)") if block_id is None else F.nullif(F.regexp_extract(col(block_id), r"/page/(\d+)", 1), F.lit("")).cast("int")


def block_level(html: str | Column, given: str | Column | None = None) -> Column:
    found = F.nullif(F.regexp_extract(col(html), r"<[hH](\d)", 1), F.lit("")).cast("int")
    return F.coalesce(*([col(given)] if given is not None else []), found, F.lit(2))


def book_name(stem: str | Column) -> Column:
    return F.lower(F.replace(col(stem), F.lit("-"), F.lit("_")))


def display_name(book: str | Column) -> Column:
    """initcap() leaves the letter after an apostrophe small."""
    return F.initcap(F.replace(col(book), F.lit("_"), F.lit(" ")))


def unfence(raw: str | Column) -> Column:
    """A model's answer without a code fence around it."""
    s = strip(raw)
    return F.when(s.startswith("```"), F.regexp_replace(s, rf"^```(?:json)?{SPACE}*|{SPACE}*```\z", "")).otherwise(s)


def braces(raw: str | Column) -> Column:
    """From the first { to the last }; null without them."""
    return F.nullif(F.regexp_extract(col(raw), r"(?s)\{.*\}", 0), F.lit(""))


def final_answer(raw: str | Column) -> Column:
    """Without a leading <think> part; null if that part never ends or nothing is left."""
    opened = rf"(?s)\A{SPACE}*<think>"
    rest = F.regexp_replace(col(raw), rf"{opened}.*?</think>{SPACE}*", "")
    return F.when(~rest.rlike(opened), F.nullif(strip(rest), F.lit("")))


def visual_name(section_id: str | Column, kind: str, n: str | Column, ext: str = "png") -> Column:
    """File name of a visual: by its number of figure or equation where it has one, else by count."""
    number = F.replace(col(n).cast("string"), F.lit("."), F.lit("-"))
    return F.concat(col(section_id), F.lit(f"_{kind}_"), number, F.lit(f".{ext}"))


def any_of(items: Sequence[str]) -> str:
    """An alternation of plain strings."""
    return "|".join(f"\\Q{x}\\E" for x in items)
