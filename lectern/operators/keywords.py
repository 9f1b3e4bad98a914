"""Term statistics of sections within their books: frequencies, TF-IDF keywords, sections that are easily confused."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from heapq import nlargest, nsmallest
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lectern.config import DEFAULTS
from lectern.functions.words import STOP_WORDS

SECTION = ("book_id", "section_id")
WORD, LONG_WORD = re.compile("[a-z0-9]+"), re.compile("[a-z0-9]{3,}")
PLACES, SLACK = Decimal("1e-9"), 2e-9
#: Characters of texts that share a table of terms, and rows of a batch.
PART_CHARS, ROWS = 4_000_000, 20_000
#: Sections with the same rare keyword that one task compares with all that have it.
CROWD = 500


def listed(column: pa.Array) -> list:
    """to_pylist() makes an object of Arrow's a value; this is several times as fast where nothing is null."""
    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_string(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def counted(rows: Iterable[tuple], stop_words) -> Iterator[tuple]:
    """((book_id, section_id), {term: (tf, first_pos)}) of rows (book_id, section_id, lower-cased text); neighbours of one
    section are put together."""
    at, held = None, {}
    for book, section, text in rows:
        if (book, section) != at:
            if held:
                yield at, held
            at, held = (book, section), {}
        words = WORD.findall(text or "")
        first = dict(zip(reversed(words), range(len(words) - 1, -1, -1)))
        for w, n in Counter(words).items():
            if len(w) >= 3 and w not in stop_words and not w.isdigit():
                m, i = held.get(w, (0, first[w]))
                held[w] = (m + n, min(i, first[w]))
    if held:
        yield at, held


def section_terms(batches: Iterator[pa.RecordBatch], stop_words) -> Iterator[tuple]:
    """counted() of batches (book_id, section_id, lower-cased text)."""
    return counted((row for batch in batches for row in zip(*map(listed, batch.columns))), stop_words)


def distinct_terms(text: str | None, stop_words) -> list[str]:
    return [w for w in set(LONG_WORD.findall(text or "")) if w not in stop_words and not w.isdigit()]


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def mapped(rows: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], columns: str) -> DataFrame:
    """f over batches of rows; what it yields are book_id, section_id as they are in rows, and columns."""
    schema = StructType([StructField(c, rows.schema[c].dataType) for c in SECTION] + StructType.fromDDL(columns).fields)
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: batched(f(batches), arrow), schema)


def lowered(sections: DataFrame) -> DataFrame:
    return sections.select(*SECTION, F.lower("text").alias("text"))


def together(rows: DataFrame) -> DataFrame:
    """A section's rows side by side."""
    return rows.repartition(*SECTION).sortWithinPartitions(*SECTION)


def _counts(rows: DataFrame, stop_words) -> DataFrame:
    flat = lambda batches: ((*at, w, *x) for at, held in section_terms(batches, stop_words) for w, x in held.items())
    return mapped(rows, flat, "term string, tf bigint, first_pos bigint")


def term_counts(sections: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """book_id, section_id, term, tf, first_pos of all keyword terms of sections (book_id, section_id, text).

    What is moved are texts, once; a section is counted where it lies.
    """
    return _counts(together(lowered(sections)), stop_words)


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("book_id", "term").agg(F.count("*").alias("df"))


def tf_keywords(sections: DataFrame, n: int = DEFAULTS.top_keywords) -> DataFrame:
    """The n most frequent terms of a section; equal ones in order of first occurrence."""

    def run(batches):
        for at, held in section_terms(batches, STOP_WORDS):
            best = nsmallest(n, held.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))
            yield from ((*at, i, w, tf) for i, (w, (tf, _)) in enumerate(best, 1))

    return mapped(together(lowered(sections)), run, "rank bigint, term string, tf bigint")


def ordered_terms(texts: list[str | None], stop_words) -> dict[str, int]:
    """{term: tf} of a section, in order of first occurrence."""
    if len(texts) > 1:
        held = next((x for _, x in counted((("", "", t) for t in texts), stop_words)), {})
        return {w: tf for w, (tf, _) in sorted(held.items(), key=lambda x: (x[1][1], x[0]))}
    found = Counter(LONG_WORD.findall(texts[0] or ""))
    return {w: n for w, n in found.items() if w not in stop_words and not w.isdigit()}


def parted(sections: DataFrame) -> DataFrame:
    """book_id, section_id, lower-cased text and part: a part is about PART_CHARS of whole sections, of one book if it has as
    many. A section is in one part; books that are larger are cut into several."""
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")
    sizes = sections.rollup("book_id").agg(chars, F.grouping_id().alias("all")).where(f"all = 1 or chars > {PART_CHARS}").collect()
    total = next((r.chars for r in sizes if r["all"]), 0)
    large = [r for r in sizes if not r["all"]]
    kind = StructType([StructField("book_id", sections.schema["book_id"].dataType), *StructType.fromDDL("cuts bigint").fields])
    cuts = sections.sparkSession.createDataFrame(pa.table([[r.book_id for r in large], [r.chars // PART_CHARS + 1 for r in large]], to_arrow_schema(kind)), kind)
    place = F.xxhash64("book_id", F.pmod(F.xxhash64("section_id"), F.coalesce("cuts", F.lit(1).cast("bigint"))))
    cut = lowered(sections).join(F.broadcast(cuts), "book_id", "left")
    return cut.select(*SECTION, "text", F.pmod(place, F.lit(total // PART_CHARS + 1).cast("bigint")).alias("part")).repartition("part")


def whole_sections(rows: pa.Table) -> dict[tuple, list]:
    """{(book_id, section_id): texts}"""
    held: dict[tuple, list] = {}
    for book, section, text in zip(*(listed(rows[c].combine_chunks()) for c in (*SECTION, "text"))):
        held.setdefault((book, section), []).append(text)
    return held


def scored_sections(sections: DataFrame, f: Callable[..., Iterator[tuple]], columns: str) -> DataFrame:
    """book_id, section_id and columns of what f(id, texts, terms {term: tf}, score) yields for a section; score(n) gives
    (term, tf, df, score) of the n terms that score best, score = tf * ln(n_sections / df), unsmoothed, to nine places, halves
    up, equal ones in order of first occurrence.

    Texts are moved once, to their parts, and counted there twice: first for the part's share of df, which is all that goes
    to the terms and back, then with df at hand."""
    texts = parted(sections)
    ids = [StructField(c, sections.schema[c].dataType) for c in SECTION]
    shares = StructType([*StructType.fromDDL("part bigint").fields, ids[0], *StructType.fromDDL("term string, n bigint").fields])
    out = StructType([*ids, *StructType.fromDDL(columns).fields])
    shares_arrow, out_arrow = to_arrow_schema(shares), to_arrow_schema(out)

    def share(rows: pa.Table) -> pa.Table:
        # the term "", which no text has, stands for the sections given
        books: dict = {}
        for (book, _), given in whole_sections(rows).items():
            if book is not None:
                n = books.setdefault(book, Counter())
                n.update(ordered_terms(given, STOP_WORDS).keys() if len(given) > 1 else distinct_terms(given[0], STOP_WORDS))
                n[""] += len(given)
        part = rows["part"][0].as_py()
        columns = (([part] * len(n), [book] * len(n), list(n), list(n.values())) for book, n in books.items())
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(x, shares_arrow)], schema=shares_arrow) for x in columns], shares_arrow)

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        dfs: dict = {}
        for book, w, df in zip(*(listed(known[c].combine_chunks()) for c in ("book_id", "term", "df"))):
            dfs.setdefault(book, {})[w] = df
        idfs: dict = {}
        for book, of in dfs.items():
            logs = {df: math.log(of[""] / df) for w, df in of.items() if w}
            idfs[book] = {w: logs[df] for w, df in of.items() if w}
        rounded: dict[float, float] = {}

        def best(of: dict, idf: dict, terms: dict, n: int) -> list[tuple]:
            raw = [tf * idf[w] for w, tf in terms.items()]
            # rounding moves a score by less than SLACK: below that, none of the best n is lost
            least = sorted(raw, reverse=True)[n - 1] - SLACK if len(raw) > n else -math.inf
            some = []
            for (w, tf), x in zip(terms.items(), raw):
                if x >= least:
                    if x not in rounded:
                        rounded[x] = float(Decimal(repr(x)).quantize(PLACES, ROUND_HALF_UP))
                    some.append((w, tf, of[w], rounded[x]))
            return sorted(some, key=lambda x: -x[3])[:n]

        def all_rows():
            for at, given in whole_sections(rows).items():
                terms = ordered_terms(given, STOP_WORDS) if at[0] is not None else {}
                of, idf = dfs.get(at[0]), idfs.get(at[0])
                yield from ((*at, *x) for x in f(at, given, terms, lambda n: best(of, idf, terms, n)))

        return pa.Table.from_batches(batched(all_rows(), out_arrow), out_arrow)

    mine = texts.groupBy("part").applyInArrow(share, shares)
    known = mine.select("part", "book_id", "term", F.sum("n").over(Window.partitionBy("book_id", "term")).alias("df"))
    return texts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(score, out)


def tfidf_keywords(sections: DataFrame, n: int = DEFAULTS.top_keywords) -> DataFrame:
    def run(at, given, terms, best):
        return ((i, *x) for i, x in enumerate(best(n) if terms else (), 1))

    return scored_sections(sections, run, "rank bigint, term string, tf bigint, df bigint, score double")


def keyword_sets(sections: DataFrame, n: int = DEFAULTS.top_keywords) -> DataFrame:
    """book_id, section_id, keywords (by frequency), tfidf_keywords, both in order of rank, and their union. A section
    without keywords, or without an id, has empty arrays."""

    def run(at, given, terms, best):
        if at[1] is None or not terms:
            return [([], [])] * len(given)
        return [(nlargest(n, terms, key=terms.get), [x[0] for x in best(n)])] * len(given)

    sets = scored_sections(sections, run, "keywords array<string>, tfidf_keywords array<string>")
    return sets.withColumn("all_keywords", F.array_union("keywords", "tfidf_keywords"))


def confusable_pairs(sets: DataFrame, above: float = DEFAULTS.confusable_overlap, group: str = "book_id") -> DataFrame:
    """Pairs of siblings (same group) that share more than ``above`` of the larger keyword set: section_a < section_b,
    overlap (two places), shared_keywords.

    sets: group, section_id, all_keywords. Sections meet at keywords in the rarest part of both sets alone (the prefix that
    a pair over the threshold can't avoid), so frequent keywords join nothing. Sets go along, so a pair is compared where it
    meets (by 64-bit hashes of keywords), and counts only at the rarest keyword that it shares: no pair is moved. A keyword
    at which many sections meet is dealt out.
    """
    own = sets.select(group, "section_id", F.col("all_keywords").alias("kw")).where(F.col(group).isNotNull() & F.col("section_id").isNotNull())
    flat = own.select(group, "section_id", F.xxhash64("kw").alias("row"), F.explode("kw").alias("term"))
    known = flat.withColumn("df", F.count("*").over(Window.partitionBy(group, "term")))
    # rows that are given several times come out as one list with each term as many times
    lists = known.groupBy(group, "section_id", "row").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("all"))
    rare_first = lists.select(group, "section_id", F.size("all").alias("size"), F.array_distinct(F.col("all.term")).alias("kw"))
    ordered = rare_first.select(group, "section_id", F.size("kw").alias("n"), "size", F.sort_array("kw").alias("kw"), F.transform("kw", lambda w: F.xxhash64(w)).alias("keys"))
    each = ordered.withColumn("copy", F.explode(F.array_repeat(F.lit(0), (F.col("size") / F.col("n")).cast("int"))))
    # over = floor(above * n) + 1 shared terms are needed at least; n - over + 1 first terms can't all be missed
    first = F.slice("keys", 1, (F.col("n") - F.floor(F.lit(above) * F.col("n"))).cast("int"))
    prefix = each.select(group, "section_id", "n", "kw", "keys", F.posexplode(first).alias("place", "key"))
    crowded = prefix.groupBy(group, "key").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("shares")).where("shares > 1")
    dealt = prefix.join(F.broadcast(crowded), [group, "key"], "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    a, b = (
        dealt.select(group, "key", share.alias("share"), *[F.col(c).alias(f"{c}_{x}") for c in ("section_id", "n", "kw", "keys", "place")])
        for x, share in (("a", F.pmod(F.xxhash64("section_id"), "shares").cast("int")), ("b", every))
    )
    larger = F.greatest("n_a", "n_b")
    # cheapest first: what follows the key must do; it can't be the first that both share if their first is the same
    may = f"section_id_a < section_id_b and least(n_a - place_a, n_b - place_b) > {above} * greatest(n_a, n_b) and (place_a = 0 or place_b = 0 or keys_a[0] <> keys_b[0])"
    both = F.array_intersect("keys_a", "keys_b")
    found = a.join(b, [group, "key", "share"]).where(may).where((F.size(both) / larger > above) & (F.element_at(both, 1) == F.col("key")))
    # in order, as kw_a is
    shared = F.array_intersect("kw_a", "kw_b").alias("shared_keywords")
    return found.select(group, F.col("section_id_a").alias("section_a"), F.col("section_id_b").alias("section_b"), F.round(F.size(both) / larger, 2).alias("overlap"), shared)


def confusable_map(pairs: DataFrame) -> DataFrame:
    """section_id, siblings (sorted): each pair once whatever its direction, single-letter sections left out."""
    letter = r"\A\p{L}\z"
    once = pairs.select(F.least("section_a", "section_b").alias("a"), F.greatest("section_a", "section_b").alias("b")).where("a <> b").distinct()
    once = once.where(~F.col("a").cast("string").rlike(letter) & ~F.col("b").cast("string").rlike(letter))
    both = once.union(once.select("b", "a"))
    return both.groupBy(F.col("a").alias("section_id")).agg(F.array_sort(F.collect_list("b")).alias("siblings"))
