"""Quality rules as a ledger of failure bits: each rule is measured once, policies and ablations only read bits.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import blank_null, space_words, unwrapped, wrapped

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper")


def _col(name: str) -> Column:
    return F.col(name)


#: The position is the rule's bit, for good: add new rules at the end.
RULES = ("few_words", "repeats", "symbols", "long_words", "short_words", "dup_lines", "upper_case")


def _failures() -> dict[str, Column]:
    n = _col("n_words")
    return {
        "few_words": n < 20,
        "repeats": 100 * _col("n_repeat_words") > 30 * n,
        "symbols": 5 * _col("n_symbols") > n,
        "long_words": _col("word_chars") > 15 * n,
        "short_words": _col("word_chars") < 2 * n,
        "dup_lines": 2 * _col("n_dup_lines") > _col("n_lines"),
        "upper_case": 10 * _col("n_upper") > 4 * _col("word_chars"),
    }


#: Versioned policies: the rules that reject. base is what every later one holds as well.
POLICIES = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "long_words", "short_words", "dup_lines", "upper_case"),
}
POLICY = "v1"


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


#: Hashes of a window, 96 bits together.
hash64, hash32 = F.xxhash64, F.hash


def _compared(s: str, kind: str, like) -> Column:
    """For each element of the array s, what like(it, the one before) says; 0 for the first."""
    before = F.concat(F.array(F.lit(None).cast(kind)), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    return F.zip_with(s, before, lambda a, b: F.coalesce(F.when(b.isNotNull(), like(a, b)), F.lit(0)))


def _repeated(s: str, k: str) -> Column:
    """The places i, in order, of the elements of s that are equal (1 in k) to the one before or after."""
    marked = F.zip_with(s, k, lambda a, same: F.struct(a["i"].alias("i"), same.alias("same")))
    again = F.zip_with(marked, F.slice(k, 2, F.size(k)), lambda a, after: F.when((a["same"] == 1) | F.coalesce(after == 1, F.lit(False)), a["i"]))
    return F.array_sort(F.filter(again, lambda x: x.isNotNull()))


def measure(docs: DataFrame) -> DataFrame:
    """docs with the measures of each whole text (null: no text); columns named as a measure are replaced.

    n_repeat_words counts words that stand in an 8-word window found twice or more. Windows of a document are put in order of
    96 bits of hash and neighbours are compared word by word. Where different ones share a hash, the document is done again
    with the words themselves as the order. A document whose 64-bit hashes are all different is done at once.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    at = lambda i: F.slice("w", i, WINDOW)
    # the documents' own columns are kept apart, so helpers may have any name
    words = wrapped(docs.select(*kept)).withColumn("t", blank_null("text")).withColumn("w", space_words(_col("t"))).withColumn("n", F.size("w"))
    hashed = words.withColumn("l", lines).withColumn(
        "h", F.when(_col("n") >= WINDOW, F.transform(F.sequence(F.lit(1), _col("n") - WINDOW + 1), lambda i: hash64(at(i)))).otherwise(F.array().cast("array<bigint>"))
    )
    places = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), hash32(at(i + 1)).alias("g"), (i + 1).alias("i"))))
    spelled = F.sort_array(F.transform("h", lambda h, i: F.struct(F.array_join(at(i + 1), " ").alias("x"), (i + 1).alias("i"))))
    # s: windows by hash; k: 1 with the words of the one before, 2 with its hash and other words; e, f: the same by words
    alike = lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])
    found = (
        hashed.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), places))
        .withColumn("k", _compared("s", "struct<h:bigint,g:int,i:int>", lambda a, b: F.when(~alike(a, b), 0).when(at(a["i"]) == at(b["i"]), 1).otherwise(2)))
        .withColumn("e", F.when(F.exists("k", lambda k: k == 2), spelled))
        .withColumn("f", _compared("e", "struct<x:string,i:int>", lambda a, b: F.when(a["x"] == b["x"], 1).otherwise(0)))
    )
    starts = found.withColumn("p", F.when(_col("e").isNotNull(), _repeated("e", "f")).otherwise(_repeated("s", "k")))
    # a window's words that the next one doesn't begin before
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    joined = F.translate("t", " \t\n\x0b\f\r", "")
    measures = {
        "n_words": _col("n"),
        "word_chars": F.length(joined),
        "n_symbols": count(_col("t"), SYMBOLS),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("l"),
        "n_chars": F.length("t"),
        "n_upper": count(_col("t"), UPPER),
    }
    return starts.select(*[_col("text") if c == "text" else _col("doc").getField(c).alias(c) for c in kept], *[measures[m].cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """The measures and ``failures``, a long with a bit for each rule of RULES that the document fails.

    A null or empty text has no words and fails few_words. Every row is judged on its own, so repeated rows and null or
    repeated ids stay as they are; extra columns pass through, those named as a measure or failures are replaced; an empty
    table gives no row.
    """
    kept = [c for c in docs.columns if c not in (*MEASURES, "failures")]
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(_failures()[r] for r in RULES)]
    # a generated column: filters on it stay above it, else each use would measure the text anew
    entry = F.struct(*MEASURES, reduce(Column.bitwiseOR, bits).alias("failures"))
    return measure(docs.select(*kept)).select(*kept, F.inline(F.array(entry)))


def keep(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows that a policy passes, with their columns as they were, whatever their names."""
    return unwrapped(ledger(wrapped(docs)).where(passes(policy)), docs.columns)


def passes(policy: str = POLICY) -> Column:
    return _col("failures").bitwiseAND(F.lit(mask(policy))) == 0


def base_failed() -> Column:
    return ~passes("base")


def ablation(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, those that fail it alone (kept if the rule went), and those kept
    as it is. Counts are of distinct bit sets, at most 2 to the number of rules."""
    sets = entries.groupBy(_col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    flat = sets.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return flat.groupBy("rule", "bit").agg(
        F.sum(F.when(_col("bits").bitwiseAND(_col("bit")) != 0, _col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(_col("bits") == _col("bit"), _col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(_col("bits") == 0, _col("n")).otherwise(0)).alias("n_kept"),
    )
