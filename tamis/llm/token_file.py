"""Token ids in a file of compressed, checksummed blocks, in ascending document order.

The texts are dealt by ranges of doc_id and sorted; each task encodes its range and cuts the ids into segments, at the
first document end past SEGMENT ids. A segment is a row of a Parquet folder, so Spark's committer and readers keep it
safe and find it in any store: part and segment number, the documents' ids and counts, `order0` (the frequencies of its
ids, which its blocks share; range_coder.frequencies), and `data`:

    "TMRC", version (1 byte: 2), nibbles per id (1 byte), blocks (4 bytes), then for each block of BLOCK ids (the last may be
    shorter): ids, bytes and CRC-32 of the ids as little-endian 32-bit numbers (4 bytes each); then the blocks' bytes.

Each block is range-coded by itself (range_coder.py), so any block can be decoded alone, given its segment's frequencies. Reading decodes all blocks of
some segments in lockstep, verifies every CRC-32 and fails on a wrong one.

Where a document starts follows from the segments' totals: sums in a part, and the parts before it. Payloads are never
shuffled; only rows of a few numbers are.

The library encodes whole texts with the file's own settings, so the string of a special token in a text gives its id.

Defined results: a null or empty text has the end id only; documents with the same doc_id lie next to each other, by the
hash of their text; a null doc_id comes first.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, scratch, table
from .grams import pieces
from .range_coder import compress, expand, frequencies

BLOCK, SEGMENT, LANES = 4096, 1 << 18, 2048
#: Characters that the library encodes at once.
CHARS = 200_000
SCHEMA = "part int, segment int, first_id {0}, docs int, ids long, doc_ids array<{0}>, counts array<int>, order0 binary, data binary"


class Tokenizer:
    """The tokenizers library on whole texts, as the file configures it; special tokens' strings give their ids, none are added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; some texts at a time, so the library's own objects stay small."""
        out, at, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHARS or i == len(texts) - 1:
                out += [np.array(array("I", e.ids), np.uint32) for e in self.library.encode_batch_fast(texts[at : i + 1], add_special_tokens=False)]
                at, size = i + 1, 0
        return out


def pack(blocks: list[np.ndarray], coded: list[bytes], nibbles: int) -> bytes:
    heads = b"".join(struct.pack("<III", len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded))
    return b"TMRC" + struct.pack("<BBI", 2, nibbles, len(blocks)) + heads + b"".join(coded)


def unpack(data: bytes) -> tuple[int, list[tuple[int, int, bytes]]]:
    """(nibbles, (ids, crc, coded bytes) of each block)."""
    if data[:4] != b"TMRC" or data[4] != 2:
        raise ValueError("not a segment of token ids")
    nibbles, n = struct.unpack_from("<BI", data, 5)
    at, out = 10 + 12 * n, []
    for i in range(n):
        ids, size, crc = struct.unpack_from("<III", data, 10 + 12 * i)
        out.append((ids, crc, data[at : at + size]))
        at += size
    if at != len(data):
        raise ValueError("a segment of token ids is cut off")
    return nibbles, out


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, nibbles: int = 4, partitions: int | None = None) -> None:
    """Encodes docs (doc_id, text) with the tokenizer file and writes the folder `path`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        tok, part, number = Tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        held, ids, counts, size, arrow = [], [], [], 0, pa.int64()

        def rows():
            blocks = [np.concatenate(i) for _, i, _ in held]
            cut = [[b[k : k + BLOCK] for k in range(0, len(b), BLOCK)] for b in blocks]
            order0 = [frequencies(b) for b in blocks]
            coded = iter(compress([x for c in cut for x in c], nibbles, [f for f, c in zip(order0, cut) for _ in c]))
            data = [pack(c, [next(coded) for _ in c], nibbles) for c in cut]
            return pa.RecordBatch.from_arrays([
                pa.array([part] * len(held), pa.int32()), pa.array(range(number - len(held), number), pa.int32()), pa.array([d[0] for d, _, _ in held], arrow),
                pa.array([len(d) for d, _, _ in held], pa.int32()), pa.array([sum(c) for _, _, c in held], pa.int64()),
                pa.array([d for d, _, _ in held], pa.list_(arrow)), pa.array([c for _, _, c in held], pa.list_(pa.int32())),
                pa.array(order0, pa.binary()), pa.array(data, pa.binary()),
            ], names=["part", "segment", "first_id", "docs", "ids", "doc_ids", "counts", "order0", "data"])

        doc_ids: list = []
        waiting = 0
        for b in batches:
            arrow = b.column(0).type
            for piece in pieces(b, 1, 1_000_000):
                for doc, one in zip(piece.column(0).to_pylist(), tok.encode([x or "" for x in piece.column(1).to_pylist()])):
                    doc_ids.append(doc)
                    ids.append(np.r_[one, np.uint32(end_id)])
                    counts.append(len(one) + 1)
                    size += len(one) + 1
                    if size >= SEGMENT:
                        held.append((doc_ids, ids, counts))
                        number, waiting = number + 1, waiting + size
                        doc_ids, ids, counts, size = [], [], [], 0
                        if waiting >= LANES * BLOCK:
                            yield rows()
                            held, waiting = [], 0
        if size:
            held.append((doc_ids, ids, counts))
            number += 1
        if held:
            yield rows()

    own.mapInArrow(run, SCHEMA.format(kind)).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, doc_id, within (ids of the segment before it), ids (array of int) of every document in the folder."""
    return _read(spark, path, False)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers) of every document, from the decoded ids."""
    from_files = _read(spark, path, True)
    totals = spark.read.parquet(path).select("part", "segment", "ids")
    parts = totals.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))  # one row per task
    inner = (F.sum("ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("ids")).alias("inner")
    starts = totals.select("part", "segment", inner).join(before, "part").select("part", "segment", (F.col("inner") + F.col("part_start")).alias("first"))
    return from_files.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _read(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    stored = spark.read.parquet(path).select("part", "segment", "doc_ids", "counts", "order0", "data")
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    what = "n_tokens long, ids_crc32 long" if digest else "ids array<int>"

    def groups(batches):
        held, lanes = [], 0
        for b in batches:
            for row in range(b.num_rows):
                part, segment, docs, counts, order0, data = (b.column(i)[row] for i in range(6))
                nibbles, blocks = unpack(data.as_py())
                held.append((part.as_py(), segment.as_py(), docs.values, np.array(counts.as_py(), np.int64), nibbles, blocks, order0.as_py()))
                lanes += len(blocks)
                if lanes >= LANES:
                    yield held
                    held, lanes = [], 0
        if held:
            yield held

    def run(batches):
        for held in groups(batches):
            for nibbles in {h[4] for h in held}:
                some = [h for h in held if h[4] == nibbles]
                every = [x for h in some for x in h[5]]
                plain = expand([c for _, _, c in every], [n for n, _, _ in every], nibbles, [h[6] for h in some for _ in h[5]])
                for (_, crc, _), ids in zip(every, plain):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                        raise ValueError("a block of token ids doesn't have its checksum")
                at = 0
                for part, segment, docs, counts, _, blocks, _ in some:
                    ids = np.concatenate(plain[at : at + len(blocks)]).astype("<u4")
                    at += len(blocks)
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    if digest:
                        view = memoryview(ids.tobytes())
                        crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                        last = [pa.array(counts), pa.array(crc, pa.int64())]
                    else:
                        last = [pa.ListArray.from_arrays(pa.array(np.r_[starts, ends[-1:]].astype(np.int32)), pa.array(ids.astype(np.int32)))]
                    cols = [pa.array([part] * len(counts), pa.int32()), pa.array([segment] * len(counts), pa.int32()), docs, pa.array(starts), *last]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "segment", "doc_id", "within", *[x.split()[0] for x in what.split(", ")]])

    return stored.mapInArrow(run, f"part int, segment int, doc_id {kind}, within long, {what}")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """The digests of docs after its ids have been written to a new folder below the shared one and read back; the folder goes then."""
    spark = docs.sparkSession
    path = scratch(spark)
    write_ids(docs, tokenizer, path, end_id)
    out = table(digests(spark, path))
    drop_table(spark, spark.read.parquet(path))
    return out
