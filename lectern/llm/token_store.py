"""Token files: ids of whole documents in segments that give access to one short document without unpacking the rest.

Segment layout (little-endian):

    magic "LTK1" | width u16 | reserved u16 | documents u32 | dictionary hash, 32 bytes
    index, one entry a document: has_id u8 | doc_id i64 | n_tokens u32 | blob start u64 | blob length u64
    blobs, each document's ids (``width`` bytes an id) as one zstandard frame against the shared dictionary

A store is a folder with ``dictionary`` (hash, bytes) and ``segments`` (part, segment, inside, n_docs, n_tokens, data), written
by Spark so that any store that Spark reaches will do. Segments of a part follow one another in ascending doc_id (null first),
and so do the parts; inside counts the tokens of the part before the segment. Texts are encoded where they lie and only their
frames are put in order; files are read where they lie.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bases, blank_null, parts, shared_dir, ship, staged, thinned, unstage
from lectern.llm.encode import encoder, forget

#: The dictionary is trained on this many documents at most, of at most so many characters, chosen by a hash of doc_id.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 8192, 32_768
SEGMENT_BYTES, SEGMENT_DOCS = 1_000_000, 1024
SEGMENTS = "part int, segment int, inside long, n_docs long, n_tokens long, data binary"
MAGIC = b"LTK1"
_HEAD = struct.Struct("<4sHHI32s")
_ENTRY = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("n_tokens", "<u4"), ("start", "<u8"), ("length", "<u8")])


def narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; where there's too little to train on, the samples themselves serve as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def pack_segment(docs: list[tuple[int | None, int, bytes]], width: int, dictionary_hash: bytes) -> bytes:
    """docs: doc_id, number of ids, frame."""
    index = np.zeros(len(docs), _ENTRY)
    at = 0
    for i, (doc_id, n, frame) in enumerate(docs):
        index[i] = (doc_id is not None, doc_id or 0, n, at, len(frame))
        at += len(frame)
    return b"".join([_HEAD.pack(MAGIC, width, 0, len(docs), dictionary_hash), index.tobytes(), *[x[2] for x in docs]])


class Segment:
    """Reads one segment; ``ids(i)`` unpacks the i-th document alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, _, n, digest = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        self.index = np.frombuffer(data, _ENTRY, n, _HEAD.size)
        self.data, self.base = memoryview(data), _HEAD.size + n * _ENTRY.itemsize
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        e = self.index[i]
        at = self.base + int(e["start"])
        raw = self.reader.decompress(self.data[at : at + int(e["length"])], max_output_size=int(e["n_tokens"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes every whole text (null: empty), appends end_id and writes the store in ascending doc_id.

    Null doc_ids come first; equal doc_ids keep any order among them; repeated rows are each written. An empty table
    gives a store without segments. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select("doc_id", blank_null("text").alias("text"))
    enc = encoder(tokenizer)
    width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    few = thinned(own, docs.count(), SAMPLE_DOCS, "doc_id")
    sample = few.where(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).select("text").collect()  # at most 512 * 8192 characters
    end = np.array([end_id], "<u4").tobytes()
    dictionary = train_dictionary([narrow(enc.encode(r["text"]) + end, width) for r in sample])
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def compress(batches):
        enc = encoder(tokenizer)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            counts, frames = [], []
            for text in batch["text"].to_pylist():
                ids = enc.encode(text) + end
                counts.append(len(ids) // 4)
                frames.append(packer.compress(narrow(ids, width)))
            yield pa.record_batch([batch["doc_id"], batch["tie"], pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "tie", "n_tokens", "frame"])

    def segment(batches):
        forget()
        part, number, inside, waiting, held = TaskContext.get().partitionId(), 0, 0, [], 0
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def flush():
            row = (part, number, inside, len(waiting), sum(x[1] for x in waiting), pack_segment(waiting, width, digest))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in batches:
            for doc_id, n, frame in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["frame"].to_pylist(), strict=True):
                waiting.append((doc_id, n, frame))
                held += len(frame) + _ENTRY.itemsize
                if held >= SEGMENT_BYTES or len(waiting) >= SEGMENT_DOCS:
                    yield flush()
                    number, inside, waiting, held = number + 1, inside + sum(x[1] for x in waiting), [], 0
        if waiting:
            yield flush()

    # Many rows may share a doc_id: what follows it in the key lets a range boundary fall between them.
    frames = staged(own.withColumn("tie", F.monotonically_increasing_id()).mapInArrow(compress, "doc_id long, tie long, n_tokens long, frame binary"), "frames")
    keys = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    ordered = frames.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "frame")
    ordered.mapInArrow(segment, SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    unstage(frames)


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """start (ids before it), data of each segment of a store; its dictionary, of at most DICTIONARY_BYTES."""
    ship(spark)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").head()["data"])
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    before = F.broadcast(bases(segments, tokens=F.sum("n_tokens")).select("part", "tokens_base"))  # a row a part
    return segments.join(before, "part").select((F.col("tokens_base") + F.col("inside")).alias("start"), "data"), dictionary


def _unpacked(spark: SparkSession, path: str, column: str, kind: pa.DataType, sql: str, of) -> DataFrame:
    """A row a document: doc_id, start, n_tokens, and of(ids) as column. Segments are unpacked one by one where they lie."""
    placed, dictionary = _placed(spark, path)

    def run(batches):
        forget()
        for batch in batches:
            for start, data in zip(batch["start"].to_pylist(), batch["data"], strict=True):
                seg, rows = Segment(data.as_buffer(), dictionary), []
                for i, e in enumerate(seg.index):
                    rows.append((int(e["doc_id"]) if e["has_id"] else None, start, int(e["n_tokens"]), of(seg.ids(i).tobytes())))
                    start += int(e["n_tokens"])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)], names=["doc_id", "start", "n_tokens", column])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column} {sql}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from a store's files: doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit)."""
    return _unpacked(spark, path, "ids", pa.binary(), "binary", lambda ids: ids)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As read(), with ids_crc32 in place of ids."""
    return _unpacked(spark, path, "ids_crc32", pa.int64(), "long", zlib.crc32)


def export_then_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes a store in the shared folder, reads it back and returns doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_dir(docs.sparkSession)}/lectern/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return digests(docs.sparkSession, path)
