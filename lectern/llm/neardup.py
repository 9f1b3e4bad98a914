"""Near-duplicates by MinHash: one-permutation sketches, banded buckets, star-shaped candidate edges, links confirmed on
full shingle sets, classes by contraction.

Documents with equal shingle sets become one node first, so a large group of copies costs one node. In a bucket one hub is
compared with all others. Where those others then belong to several classes, pairs among them are found by an exact
set-similarity join with prefix, size and position filters. So every pair of a bucket is compared, joined by other links, or
shown to be too different, without a cap and without all pairs of a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import blank_null, ship, spread, staged, unstage, unwrapped, wrapped

#: 32 bands of 4 of 128 bins: of pairs at 0.8, one in 2e7 shares no band.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Up to so many candidate nodes (16 bytes each) are broadcast to find their texts; more are joined by shuffle.
BROADCAST_NODES = 200_000
KEPT_WORDS = 100_000
#: Rows of one side of a slice of a self-join, and pairs of one text that are confirmed together.
SLICE = 256

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


_HASHES = _WordHashes()


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, A-Z lower-cased, words [^\\x20\\x09-\\x0D]+.

    With fewer words than size, the whole sequence is one shingle; without words there's none. Two shingles of a corpus
    share a hash by chance with probability 2**-64.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    k = min(size, n)
    out = h[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        out = out * _K + h[i : n - k + 1 + i]
    return np.unique(mix(out))


def _probes() -> np.ndarray:
    """For each bin, an order in which an empty bin looks for one to borrow from; the same for all documents."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_PROBES = _probes()
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """Band keys of a non-empty set: the least hash of each bin, empty bins densified by probing, ROWS bins a band."""
    bins = (hashes >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    sketch, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sketch[bins[first]], full[bins[first]] = hashes[first], True
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _PROBES[empty]
        sketch[empty] = sketch[order[np.arange(len(empty)), full[order].argmax(1)]]
    rows = mix(sketch).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out * _K + rows[:, i])
    return out.view(np.int64)


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch[name].cast(pa.binary()).to_pylist()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row, n_shingles, fp (of the set; null where it's empty), bands."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts, prints, keys = [], [], []
            for text in _binary(batch, "text"):
                own = shingles(text, size)
                counts.append(len(own))
                prints.append(fingerprint(own) if len(own) else None)
                keys.append(bands(own) if len(own) else None)
            yield pa.record_batch([batch["doc_id"], batch["row"], pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "n_shingles", "fp", "bands"])

    return docs.select("doc_id", "row", blank_null("text").alias("text")).mapInArrow(run, "doc_id long, row long, n_shingles long, fp binary, bands array<long>")


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _texts(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of each of nodes (node, row)."""
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    return own.select("row", blank_null("text").alias("text")).join(nodes, "row").select("node", "text")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs (a, b) whose full sets reach the threshold. A text of many pairs as a is sent along once for each slice of them."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def get(node, text):
            if node not in kept:
                if len(kept) >= 32:
                    kept.clear()
                kept[node] = shingles(text, size)
            return kept[node]

        for batch in batches:
            yes = []
            for a, b, s, t in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), _binary(batch, "ta"), _binary(batch, "tb"), strict=True):
                x, y = get(a, s), get(b, t)
                yes.append(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    sliced = spread(pairs, slices, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    left = texts.join(slices, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("text").alias("ta"))
    return sliced.join(right, "b").join(left, ["a", "slice"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame | None:
    """node, root (the smallest node reachable) for all nodes of edges (a, b); None without edges.

    Each node hooks on to its smallest neighbour, chains are halved until all point at roots, edges are rewritten between
    roots: the number of roots with edges halves at least in each phase.
    """
    labels, edges = None, staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = staged(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("root")), "parents")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = staged(spread(up, over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "parents")
            moved = not jumped.where("moved").isEmpty()
            unstage(up)
            up = jumped
            if not moved:
                break
        up = up.select("node", "root")
        up._staged_at = jumped._staged_at
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")]
        rest = staged(spread(edges, ends[0], "a").join(ends[1], "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        unstage(edges)
        edges = rest
        if labels is None:
            labels = up
        else:
            old, labels = labels, staged(relabel(labels, up), "labels")
            unstage(old, up)
    unstage(edges)
    return labels


def relabel(labels: DataFrame, up: DataFrame) -> DataFrame:
    """labels (node, root) with roots replaced by what up (node, root) says of them."""
    over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return spread(labels, over, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose sets of word shingles have a Jaccard similarity of percent or more, transitively.

    docs: doc_id, text; other columns are ignored. One row a document: doc_id, n_shingles, component_id (the smallest
    doc_id of the class), kept (doc_id = component_id, null-safe), and class_id, row, that tell classes and rows apart where
    doc_ids don't. A document without words is alone in its class. Null
    doc_ids take part; the smallest is taken of those that aren't null, and is null where all are. Rows that share a
    doc_id are judged each by its own text, and repeated rows are alike. An empty table gives no row.
    """
    own = staged(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows")
    out = _judged(own, size, percent)
    unstage(own)
    return out


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs, of which one row of each class stays: one with the smallest doc_id. Documents without words all stay.

    Columns come back as they were, whatever their names. Null doc_ids come last in a class; of repeated rows and of rows that
    share a doc_id any one stays. An empty table gives no row.
    """
    own = staged(wrapped(docs).withColumns({"doc_id": F.col("doc").getField("doc_id"), "row": F.monotonically_increasing_id()}), "rows")
    classes = _judged(own.select("doc_id", "text", "row"), size, percent).select("row", "doc_id", "class_id")
    alone = classes.where("class_id is null").select("row")
    best = classes.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    kept = best.select(F.col("best.row").alias("row")).union(alone)
    return unwrapped(own.join(kept, "row", "left_semi"), docs.columns)


def _judged(own: DataFrame, size: int, percent: int) -> DataFrame:
    """near_duplicates() of staged rows (doc_id, text, row)."""
    all_docs = staged(sketches(own, size), "sketches")
    least = all_docs.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    # The smallest node of a bucket is its hub: one with many copies, as others are most likely made from it.
    node = F.monotonically_increasing_id() + F.shiftleft(63 - F.floor(F.log2("copies")), 57)
    nodes = staged(least.withColumn("node", node), "nodes")
    labels = _classes(own, nodes, size, percent)
    named = nodes.select("node", "fp", "rep")
    if labels is None:
        classes = named.select("fp", F.col("rep").alias("component_id"), F.col("node").alias("class_id"))
    else:
        smallest = labels.join(named, "node").groupBy("root").agg(F.min("rep").alias("least"))
        roots = spread(labels, smallest, "root").select("node", "root", "least")
        component = F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least"))
        classes = named.join(roots, "node", "left").select("fp", component.alias("component_id"), F.coalesce("root", "node").alias("class_id"))
    some = spread(all_docs.where("fp is not null").select("doc_id", "row", "n_shingles", "fp"), classes, "fp")
    none = all_docs.where("fp is null").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    out = some.drop("fp").unionByName(none)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id", "row")


def _classes(own: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """node, root of nodes that have links."""
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    stars = staged(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n")).where("m > 1"), "stars")
    members = staged(spread(keyed, stars, "key").where("node <> hub").select("key", "node", "n", "hub", "hub_n"), "members")
    unstage(stars)
    pairs = members.where(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    labels = _linked(own, nodes, staged(pairs.distinct(), "pairs"), size, percent, None)
    # Where the others of a bucket are of several classes, pairs among them are still open.
    rooted = members.select("key", "node") if labels is None else members.select("key", "node").join(labels, "node", "left")
    root = F.col("node") if labels is None else F.coalesce("root", "node")
    open_ = rooted.groupBy("key").agg(F.min(root).alias("lo"), F.max(root).alias("hi")).where("lo <> hi").select("key")
    rest = staged(spread(members.select("key", "node"), open_, "key").select("node").distinct(), "open")
    unstage(members)
    if not rest.isEmpty():
        texts = staged(_texts(own, rest.join(nodes, "node").select("node", "row")), "texts")
        labels = _linked(own, nodes, _prefix_pairs(texts, labels, size, percent), size, percent, labels, texts)
    unstage(rest)
    return labels


def _linked(own: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int, labels: DataFrame | None, texts: DataFrame | None = None) -> DataFrame | None:
    """labels with the classes joined that confirmed pairs link. Deletes pairs, texts and the labels that it replaces."""
    if pairs.isEmpty():
        unstage(pairs, *[texts] * (texts is not None))
        return labels
    if texts is None:
        ends = staged(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node").select("node", "row"), "ends")
        texts = staged(_texts(own, ends), "texts")
        unstage(ends)
    links = staged(_confirm(pairs, texts, size, percent), "links")
    unstage(texts, pairs)
    if labels is None:
        out = components(links)
    else:
        inside = [labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")]
        up = components(links.join(inside[0], "a", "left").join(inside[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        out = labels
        if up is not None:
            out = staged(relabel(labels, up).union(up.join(labels.select("node"), "node", "left_anti")), "labels")
            unstage(labels, up)
    unstage(links)
    return out


def _prefix_pairs(texts: DataFrame, labels: DataFrame | None, size: int, percent: int) -> DataFrame:
    """All pairs (a, b) of texts (node, text) that may reach the threshold and aren't of one class yet.

    Shingles are put in order of their frequency among these texts, rarest first. Two sets that reach the threshold share
    one of their first shingles of that order (so many that not all can be missed), are of similar size, and from the place
    of the first shared one enough is left in both. Shingles of one text alone take places but join nothing: a text that
    has too many of its own, as a far-off copy in a large family has, is in no pair. Texts of the class that most texts with
    a shingle are of aren't paired among themselves, a shingle of one class pairs nothing, and the texts with a shingle are
    cut into slices, so that many with one shingle neither meet in one task nor are all paired.
    """

    def run(batches):
        for batch in batches:
            own = [shingles(t, size).view(np.int64) for t in _binary(batch, "text")]
            sizes = [len(x) for x in own]
            columns = np.repeat(batch["node"].to_numpy(), sizes), np.repeat(np.array(sizes, np.int64), sizes), np.concatenate([np.empty(0, np.int64), *own])
            yield pa.record_batch([pa.array(c) for c in columns], names=["node", "n", "h"])

    flat = staged(texts.mapInArrow(run, "node long, n long, h long"), "shingles")
    shared = spread(flat, flat.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "h")
    own = Window.partitionBy("node")
    pos = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h"))
    first = shared.select("node", "n", "h", pos.alias("pos")).where(f"pos <= n - ({percent} * n + 99) div 100 + 1")
    rooted = first.withColumn("root", F.col("node")) if labels is None else first.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = staged(rooted.select("h", "node", "n", "pos", "root"), "prefixes")
    unstage(flat)
    mixed = rooted.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("m"), F.max("c").alias("top"), F.max_by("root", "c").alias("major"))
    mixed = mixed.where("top < m").select("h", "major", F.ceil(F.col("m") / SLICE).alias("slices"))
    grouped = spread(rooted, mixed, "h")
    a, b = (grouped.select("h", "slices", (F.col("root") == F.col("major")).alias(f"in{x}"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
    a = a.where("not ina").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices", "ina")
    b = b.withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices"))).drop("slices")
    left = "(1 + least(na - pa, nb - pb))"
    fits = f"(inb or a < b) and ra <> rb and 100 * least(na, nb) >= {percent} * greatest(na, nb) and 100 * {left} >= {percent} * (na + nb - {left})"
    pairs = staged(a.join(b, ["h", "slice"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    unstage(rooted)
    return pairs
