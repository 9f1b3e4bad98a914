"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or a run of words across lines: from one of a template's words on, as long as the template with a fifth more
words, so that a statement broken over lines is found too. A template's label is given to a document if one of its blocks has
at least THRESHOLD of the template's distinct words, all words that tell it from its kin (TELLING) and none that make it another
(NEVER).

Template words are put in order of corpus frequency, rarest first. Of two sets that share enough words each holds a common one
among its first words of that order (the prefix), both are long enough, and from the places of the first common word enough of
both orders is left; what passes these filters is compared in full, so nothing is missed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ALNUM_BYTES, blank_null, ship

THRESHOLD = (9, 10)

#: Phrases whose words must stand one after another, anywhere in a text.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, statement). Written for this catalogue; several statements may share a label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "Licensed under the Apache License Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License version 2"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)


#: Words that tell kin apart: a block must have those that the template has.
TELLING = frozenset("2 3 4 lesser affero apache mozilla sa sharealike nc noncommercial nd noderivatives".split())
#: Words that a block may not have for a label.
_SA, _NC, _ND = ("sa", "sharealike"), ("nc", "noncommercial"), ("nd", "noderivatives")
NEVER = {"cc-by-4.0": _SA + _NC + _ND, "cc-by-sa-4.0": _NC + _ND, "cc-by-nc-4.0": _SA + _ND, "cc-by-nd-4.0": _NC + _SA, "cc-by-nc-sa-4.0": _ND, "cc-by-nc-nd-4.0": _SA}


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(ALNUM_BYTES).split()


def word_sets(templates=TEMPLATES) -> list[tuple[str, tuple[bytes, ...]]]:
    return [(label, tuple(sorted(set(words(text.encode()))))) for label, text in templates]


def must(own: tuple[bytes, ...]) -> list[str]:
    """Words of a template that a block can't do without."""
    return sorted(TELLING.intersection(w.decode() for w in own))


def needed(n: int) -> int:
    """Words that a block must share with a template of n."""
    return -(-n * THRESHOLD[0] // THRESHOLD[1])


def window(statement: str) -> int:
    """Words of a run across lines that is compared with a statement; the fifth more leaves room for comment marks."""
    n = len(words(statement.encode()))
    return n + n // 5


def word_blocks(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """word, blocks: in how many blocks of the corpus each template word stands; a row a template word at most."""
    ship(docs.sparkSession)
    catalogue = frozenset(w for _, own in word_sets(templates) for w in own)

    def run(batches):
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"].cast(pa.binary()).to_pylist():
                for line in text.split(b"\n"):
                    seen.update(catalogue.intersection(words(line)))
        yield pa.record_batch([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "blocks"])

    own = docs.select(blank_null("text").alias("text")).mapInArrow(run, "word string, blocks long")
    return own.groupBy("word").agg(F.sum("blocks").alias("blocks"))


class Join:
    """The templates' side of the join, for words ordered by frequency."""

    def __init__(self, sets: list[tuple[str, tuple[bytes, ...]]], frequency: dict[bytes, int]):
        every = sorted({w for _, own in sets for w in own}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: r for r, w in enumerate(every)}
        self.templates, self.prefix = [], {}
        as_bytes = lambda words: frozenset(w.encode() for w in words)
        for t, (label, own) in enumerate(sets):
            order, need = sorted(own, key=self.rank.__getitem__), needed(len(own))
            self.templates.append((label, frozenset(own), need, as_bytes(must(own)), as_bytes(NEVER.get(label, ()))))
            for place, w in enumerate(order[: len(order) - need + 1]):
                self.prefix.setdefault(self.rank[w], []).append((t, place))

    def candidates(self, block: set[bytes]):
        """Templates that a block passes the filters of; each at most once."""
        order = sorted(self.rank[w] for w in self.rank.keys() & block)
        tried = set()
        for j, r in enumerate(order):
            for t, i in self.prefix.get(r, ()):
                if t in tried:
                    continue
                tried.add(t)
                _, own, need, _, _ = self.templates[t]
                # this is the first word in common: what is shared lies at i and j or after them
                if min(len(own) - i, len(order) - j) >= need:
                    yield t

    def held(self, block: set[bytes]):
        """(template, share) of the templates that the block holds enough of."""
        for t in self.candidates(block):
            _, own, need, _, _ = self.templates[t]
            both = len(own & block)
            if both >= need:
                yield t, both / len(own)

    def labels(self, block: set[bytes]) -> dict[str, float]:
        """label -> largest share of a template found in the block."""
        out: dict[str, float] = {}
        for t, share in self.held(block):
            label, _, _, telling, never = self.templates[t]
            if telling <= block and never.isdisjoint(block):
                out[label] = max(out.get(label, 0.0), share)
        return out

    def runs(self, own: list[bytes], widths: list[int]):
        """(place, label, share) of the runs of a template's width, from one of its words on, that are taken for it."""
        for t, _ in self.held(set(own)):
            label, wanted, need, telling, never = self.templates[t]
            places = [i for i, w in enumerate(own) if w in wanted or w in never]
            inside: Counter[bytes] = Counter()
            end = both = barred = 0
            for at in places:
                while end < len(places) and places[end] < at + widths[t]:
                    w = own[places[end]]
                    inside[w] += 1
                    both += w in wanted and inside[w] == 1
                    barred += w in never
                    end += 1
                w = own[at]
                if w in wanted and both >= need and not barred and all(inside[x] for x in telling):
                    yield at, label, both / len(wanted)
                inside[w] -= 1
                both -= w in wanted and not inside[w]
                barred -= w in never


def phrase_places(own: list[bytes], phrases) -> list[tuple[int, str]]:
    out = []
    for phrase, label in phrases:
        first, at = phrase[0], -1
        try:
            while True:
                at = own.index(first, at + 1)
                if tuple(own[at : at + len(phrase)]) == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and blocks, the
    lines (from 0) on which a block with the label of a template begins, and the largest share of its words.

    n_base counts the places of the base phrases over the whole text, first_word and last_word are their smallest and
    largest start. labels joins the templates' labels and the base ones. score is 1 with a base phrase, else the largest
    share of an accepted template, else 0. A null or empty text has no words. Null and repeated ids and repeated rows are
    scanned one by one; other columns are ignored; an empty table gives no row.
    """
    ship(docs.sparkSession)
    sets, widths = word_sets(templates), [window(text) for _, text in templates]
    frequency = {r["word"].encode(): r["blocks"] for r in word_blocks(docs, templates).collect()}  # a row a template word
    phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]

    def run(batches):
        join = Join(sets, frequency)
        marks, starters = join.rank.keys(), {p[0] for p, _ in phrases}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                own = words(text)
                places = [] if starters.isdisjoint(own) else phrase_places(own, phrases)
                shares: dict[tuple[int, str], float] = {}
                if not marks.isdisjoint(own):
                    ends = []
                    for i, line in enumerate(text.split(b"\n")):
                        block = words(line)
                        ends.append((ends[-1] if ends else 0) + len(block))
                        for label, share in join.labels(set(block)).items():
                            shares[i, label] = share
                    if len(ends) > 1:
                        for at, label, share in join.runs(own, widths):
                            key = bisect_right(ends, at), label
                            shares[key] = max(shares.get(key, 0.0), share)
                blocks = [{"line": i, "label": label, "share": share} for (i, label), share in sorted(shares.items())]
                base = {x[1] for x in places}
                score = 1.0 if base else max((x["share"] for x in blocks), default=0.0)
                starts = [x[0] for x in places]
                rows.append((doc_id, len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *(x["label"] for x in blocks)})), score, blocks))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("share", pa.float64())])))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return docs.select("doc_id", blank_null("text").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:bigint,label:string,share:double>>"
    )
