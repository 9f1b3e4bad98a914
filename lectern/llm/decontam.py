"""Benchmark decontamination: an FM-index of each training shard answers where test phrases stand.

A shard is a run of documents of one partition (about SHARD_WORDS words). Its words become symbols; the suffix array gives
the Burrows-Wheeler transform, kept as a wavelet matrix with popcount ranks. All phrases are searched backwards at once;
their occurrences are located by walking to sampled suffix positions, and overlapping ones are merged into spans. A benchmark
of any size goes out in blocks; each is searched in an index while that is there, so an index is built once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import ALNUM_BYTES, ship, wrapped

WINDOW = 13
SHARD_WORDS = 750_000
#: Suffix positions kept in the index: every so many words.
SAMPLE = 16
#: Benchmark text that the driver or a task holds at once; more is searched in several blocks.
BLOCK_BYTES = 2_000_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

_END, _STOP = 0, 1  # of the shard, of a document; words follow


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(ALNUM_BYTES).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling over the groups that are still tied. The last symbol must be the least and stand once."""
    n, bits = len(s), max(1, int(s.max()).bit_length())
    k = max(1, 62 // bits)
    k = min(k, 3)
    key = s.astype(np.int64)
    for i in range(1, k):
        nxt = np.zeros(n, np.int64)
        nxt[: n - i] = s[i:]
        key = key << bits | nxt
    order = np.argsort(key)
    key = key[order]
    slots = np.arange(n)
    head = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, slots, 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, -1
    tied = slots
    h = k
    while True:
        # slots whose group has more than one
        same = np.diff(head) == 0
        many = np.zeros(len(head), bool)
        many[1:] |= same
        many[:-1] |= same
        tied, head = tied[many], head[many]
        if not len(tied):
            return order
        pos = order[tied]
        key = head << 32 | rank[np.minimum(pos + h, n)] + 1
        o = np.argsort(key)
        pos, key = pos[o], key[o]
        order[tied] = pos
        first = np.diff(key, prepend=-1) != 0
        head = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        rank[pos] = head
        h *= 2


class FMIndex:
    def __init__(self, s: np.ndarray):
        """s: symbols, ended by a 0 that stands there alone."""
        self.n = len(s)
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.levels = []
        cur = self.bwt
        for bit in range(int(s.max()).bit_length() - 1, -1, -1):
            on = (cur >> bit & 1).astype(bool)
            packed = np.packbits(on, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((bit, packed, ones, self.n - int(ones[-1])))
            cur = np.concatenate([cur[~on], cur[on]])
        kept = sa % SAMPLE == 0
        self.kept, self.at = kept, np.cumsum(kept) - 1
        self.positions = sa[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands before place i of the transform."""
        lo = np.zeros_like(i)
        for bit, packed, ones, zeros in self.levels:
            on = (c >> bit & 1).astype(bool)
            down = []
            for x in (lo, i):
                w = x >> 6
                r = ones[w] + np.bitwise_count(packed[w] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                down.append(np.where(on, zeros + r, x - r))
            lo, i = down
        return i - lo

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before[c] + self.rank(c, i)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open ranges of suffixes that start with each row of phrases."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            both = self.step(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = both[: len(c)], both[len(c) :]
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Positions of suffixes: back to the next sampled one."""
        out, at, steps, todo = np.empty(len(slots), np.int64), slots.copy(), 0, np.arange(len(slots))
        while len(todo):
            here = self.kept[at]
            out[todo[here]] = self.positions[self.at[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            at = self.step(self.bwt[at], at)
            steps += 1
        return out


def windows(codes: np.ndarray, ends: np.ndarray, window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Windows of a run of items, of which item i ends before place ends[i]: length -> (rows of codes, item of each row).

    An item of fewer words, but not none, is one window. Rows with a code below 0 (a word that isn't there) are left out.
    """
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    out = {}
    for length in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
        items = np.flatnonzero(np.minimum(sizes, window) == length)
        n = sizes[items] - length + 1
        starts = np.repeat(begins[items] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        rows = np.lib.stride_tricks.sliding_window_view(codes, length)[starts]
        known = (rows >= 0).all(1)
        if known.any():
            out[length] = rows[known].astype(np.int64), np.repeat(items, n)[known]
    return out


def search_shard(texts: list[bytes], blocks: Iterable[list[tuple[str, bytes]]], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, merged spans (first word, word after the last), ids of the items found."""
    codes: dict[bytes, int] = defaultdict(count(_STOP + 1).__next__)
    seqs, starts, at = [], [], 0
    for text in texts:
        own = words(text)
        seqs.append(np.fromiter(map(codes.__getitem__, own), np.int32, len(own)))
        starts.append(at)
        at += len(own) + 1
    stop = np.array([_STOP], np.int32)
    s = np.concatenate([x for seq in seqs for x in (seq, stop)] + [np.array([_END], np.int32)])
    sizes = [len(x) for x in seqs]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[str]] = [set() for _ in texts]
    index, starts, edge = None, np.array(starts), np.zeros(len(s) + 1, np.int64)
    for block in blocks:
        split = [words(text) for _, text in block]
        wanted = np.fromiter((codes.get(w, -1) for own in split for w in own), np.int64)
        for length, (rows, items) in windows(wanted, np.cumsum([len(x) for x in split]), window).items():
            index = index or FMIndex(s)
            lo, hi = index.search(rows)
            live = np.flatnonzero(hi > lo)
            if not len(live):
                continue
            n = hi[live] - lo[live]
            pos = index.locate(np.repeat(lo[live] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())))
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + length, -1)
            docs = np.searchsorted(starts, pos, side="right") - 1
            for p in np.unique(docs * len(block) + np.repeat(items[live], n)).tolist():
                found[p // len(block)].add(block[p % len(block)][0])
    hit = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    for d, a, b in zip((np.searchsorted(starts, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    return list(zip(sizes, spans, found, strict=True))


def _blocks(benchmark: DataFrame):
    """Items in runs of BLOCK_BYTES of text at most (or one item), streamed through the driver."""
    held, size = [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        text = r["text"].encode()
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r["item_id"] or "", text))
        size += len(text)
    if held:
        yield held


SPANS = "array<struct<first:bigint,last:bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of docs, and n_words, hit_spans (first word and the word after the last, merged, words from 0) and
    hit_items (ids as sorted distinct strings).

    Nothing is shuffled: each task indexes its own documents. The benchmark goes out in blocks of bounded size. A null text
    or an empty one has no words; items without words match nothing; a null item_id counts as the empty string; equal texts and repeated
    rows are found one by one. Columns of docs named as a result are replaced. An empty benchmark leaves all unhit.
    """
    ship(docs.sparkSession)
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(items) for items in _blocks(benchmark)]  # of each the driver keeps the handle alone
    fields = [*docs.schema.fields, T.StructField("n_words", T.LongType()), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in (("hit_spans", SPANS), ("hit_items", "array<string>"))]]
    return docs.mapInArrow(_task(blocks, window), T.StructType(fields))


def _task(blocks: list[Broadcast], window: int):
    def held():
        """The blocks, one after another; where there are several, one is let go before the next is read."""
        for b in blocks:
            yield b.value
            if len(blocks) > 1:
                del b._value

    def run(batches):
        waiting, size = [], 0

        def flush():
            found = iter(search_shard([t for b in waiting for t in _texts(b)], held(), window))
            for b in waiting:
                n_words, spans, ids = zip(*[next(found) for _ in range(b.num_rows)], strict=True)
                new = {"n_words": pa.array(n_words, pa.int64()), "hit_spans": pa.array([[{"first": a, "last": z} for a, z in x] for x in spans], _SPANS), "hit_items": pa.array([sorted(x) for x in ids], pa.list_(pa.string()))}
                yield pa.record_batch([*b.columns, *new.values()], names=[*b.schema.names, *new])

        for batch in batches:
            sizes = np.cumsum([len(t) // 6 + 2 for t in _texts(batch)])
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + SHARD_WORDS - size, side="right")))
                waiting.append(batch.slice(at, to - at))
                size += int(sizes[to - 1]) - done
                at = to
                if size >= SHARD_WORDS or at < batch.num_rows:
                    yield from flush()
                    waiting, size = [], 0
        if waiting:
            yield from flush()

    return run


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])


def contaminated() -> Column:
    """A twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def cut_spans(text: str, spans: list[dict]) -> str:
    """text without the words of spans; what stood between the cut words goes with them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["first"]][0]])
        at = places[s["last"] - 1][1]
    return "".join([*out, text[at:]])


_LOWER = {i: i + 32 for i in range(0x41, 0x5B)}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents and without the hit passages of others; all columns but text come back as they
    were, whatever their names. was_cut tells rows apart whose text has changed."""
    cleaned = clean(find(wrapped(docs), benchmark, window)).withColumn("was_cut", F.size("hit_spans") > 0)
    return cleaned.select("doc", "text", "was_cut")


def clean(found: DataFrame) -> DataFrame:
    """find()'s rows without contaminated documents, and without the hit spans in the others' texts."""
    kept = found.withColumn("n_hit", n_hit()).where(~contaminated()).drop("n_hit")

    def run(batches):
        for b in batches:
            texts = [cut_spans(t, own) if own else t for t, own in zip(b["text"].to_pylist(), b["hit_spans"].to_pylist(), strict=True)]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, b.schema.field("text").type))

    return kept.mapInArrow(run, kept.schema)
