"""Best-fit packing: whole documents into as few sequences of a context length as can be.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the plan is made once on a histogram of
lengths, whatever the corpus size: the longest length left is set, a bitset subset-sum over the lengths that are left finds
the fullest rest (minimum slack), and the combination is taken as many times as the counts allow. Each document then finds
its place from its length and its rank among the documents of that length. Nothing larger than the histogram meets in one
task or on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import blank_null, ship, staged
from lectern.llm.encode import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_RANK_BITS = 44


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (given in descending order) with the largest sum up to room: length -> how many."""
    reach, within, trail = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        n, before, step = min(counts[length], room // length), reach, 1
        while n > 0:  # powers of two and a rest reach each number of copies up to n
            take = min(step, n)
            reach |= (reach << (length * take)) & within
            n, step = n - take, step * 2
        if reach != before:
            trail.append((length, before))
        if reach >> room & 1:
            break
    at, need = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        while not before >> at & 1:
            at -= length
            need[length] = need.get(length, 0) + 1
    return need


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies in a sequence}) until no document is left."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    order, out = sorted(counts, reverse=True), []
    while order:
        counts[longest := order[0]] -= 1
        rest = [x for x in order if counts[x] and x <= capacity - longest]
        need = fullest(rest, counts, capacity - longest)
        counts[longest] += 1
        need[longest] = need.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= times * k
        out.append((times, need))
        order = [x for x in order if counts[x]]
    return out


def _segments(plans: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks that one entry of the plan takes, sorted by length and first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, need in plans:
        offset = 0
        for length in sorted(need, reverse=True):
            first = used.get(length, 0)
            rows.append(((length << _RANK_BITS) + first, first, sequence, need[length], offset))
            used[length] = first + times * need[length]
            offset += length * need[length]
        sequence += times
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "sequence", "copies", "offset"), cols.T, strict=True))


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    at = n % capacity if n > capacity else min(n, capacity)
    if at:
        yield 0, at
    while at < n:
        yield at, capacity
        at += capacity


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the input partition and the rank among its pieces of that length. With keep_ids, a
    column ids holds each piece's ids as little-endian unsigned 32-bit bytes."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES + ", ids binary" * keep_ids

    def run(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = enc.encode(text) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), part, seen[length]) + (own,) * keep_ids)
                    seen[length] += 1
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", blank_null("text").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every document (columns doc_id, text; others are ignored) into sequences of at most ``capacity`` tokens.

    A document is its ids and end_id. Only documents longer than the capacity are cut, into full pieces but for the first.
    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id (from 0), offset (gapless in a sequence).
    A null text counts as empty (the end id alone); null and repeated doc_ids and repeated rows are each packed on their
    own; an empty table gives no row.
    """
    pieces = staged(tokenize(docs, tokenizer, capacity, end_id), "pieces")
    return place(pieces, capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Gives staged pieces (see tokenize) their sequence and offset."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = _segments(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(runs["key"], (length << _RANK_BITS) + rank, side="right") - 1
            k = rank - runs["first"][at]
            sequence = runs["sequence"][at] + k // runs["copies"][at]
            offset = runs["offset"][at] + k % runs["copies"][at] * length
            yield pa.record_batch([*[batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in PLACED.split(", ")])

    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PLACED)
