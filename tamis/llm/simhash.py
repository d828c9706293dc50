"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: one pass over the texts. Documents with the same fingerprint are one class from then on, so copies cost
nothing further. Two classes within `radius` bits share at least `choose` of radius + choose bands of the 64 bits, so
each fingerprint goes to one bucket per set of `choose` bands; more classes mean a larger `choose` and smaller buckets,
never fewer links. A bucket over SPLIT rows is cut into pieces that meet two by two in tasks of their own.

In a bucket, 64 fingerprints form a block that is held as 64 bit planes of one word each. A fingerprint meets a block
plane by plane: the words in which bits differ are summed by carry-save adders into bitwise counters, 64 distances at
a time, and a (fingerprint, block) pair is abandoned once all its counters are over the radius. Linked rows are joined
in the task and leave it as a forest, at most one edge per row and bucket, never as all pairs.

Defined results: a null, empty or wordless text has fingerprint zero and links like any other; a null doc_id is no
representative unless its class has no other; repeated rows stay repeated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, row_keys, table
from .components import components

BITS = 64
BLOCK = 64
SPLIT = 8192
#: Pairs of (fingerprint, block) that are compared at once.
AT_ONCE = 1 << 17


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        joined = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(id, fp: long) for every row of docs."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    own = docs.select(id_col, "text")
    return own.mapInArrow(run, f"{id_col} {own.schema[id_col].dataType.simpleString()}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: bit i of word k of a block is bit k of its fingerprint i; the last block is filled with zeros."""
    n = -(-len(fps) // BLOCK)
    full = np.zeros(n * BLOCK, np.uint64)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(n, BLOCK, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(n, BITS, 8).copy().view(np.uint64)[:, :, 0]


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near(fps: np.ndarray, vertical: np.ndarray, rows: np.ndarray, blocks: np.ndarray, valid: np.ndarray, radius: int) -> tuple:
    """(rows, blocks, words) of the pairs whose word has a bit for each lane of valid within radius bits of the row.

    The counters hold distances up to 2^n - 1 in n words, with n = 3 for radii up to 7; what exceeds them stays set in `over`.
    """
    count = [np.zeros(len(rows), np.uint64)] * max(3, radius.bit_length())
    over = count[0]
    for at in range(0, BITS, 8):
        block, own = vertical[blocks, at : at + 8], fps[rows]
        d = [block[:, i] ^ (np.uint64(0) - ((own >> np.uint64(at + i)) & np.uint64(1))) for i in range(8)]
        for x, y in ((d[0], d[1]), (d[2], d[3]), (d[4], d[5]), (d[6], d[7])):
            count[0], carry = _csa(count[0], x, y)
            for k in range(1, len(count)):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over = over | carry
        alive = valid & ~(over | _exceeds(count, radius))
        on = alive != 0
        if not on.all():
            rows, blocks, valid, over, alive = (x[on] for x in (rows, blocks, valid, over, alive))
            count = [x[on] for x in count]
        if not len(rows):
            break
    return rows, blocks, alive if len(rows) else valid


def _exceeds(count: list, radius: int):
    """Lanes whose count, low bit first, is over radius."""
    out, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        bit = radius >> k & 1
        out = out | (same & count[k]) if not bit else out
        same = same & (count[k] if bit else ~count[k])
    return out


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of rows i and j; label holds the smallest row of each set, directly."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def pairs_sorted(fps: np.ndarray, group: np.ndarray, radius: int):
    """(i, j) arrays of the rows i < j within radius bits in the same group; rows are sorted by group."""
    n = len(fps)
    change = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.r_[0, change], np.r_[change, n]
    end = np.repeat(ends, ends - starts)
    vertical, row = planes(fps), np.arange(n)
    first, last = (row + 1) // BLOCK, (end - 1) // BLOCK
    count = np.where(row + 1 < end, last - first + 1, 0)
    edges = np.r_[0, np.cumsum(count)]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + AT_ONCE, "right")) - 1)
        c = count[at:to]
        rows = np.repeat(row[at:to], c)
        blocks = np.arange(len(rows)) - np.repeat(edges[at:to] - edges[at], c) + np.repeat(first[at:to], c)
        low = np.maximum(rows + 1 - blocks * BLOCK, 0).astype(np.uint64)
        high = np.minimum(end[rows] - blocks * BLOCK, BLOCK).astype(np.uint64)
        ones = ~np.uint64(0)
        valid = (ones << low) & (ones >> (np.uint64(BLOCK) - high))
        rows, blocks, words = near(fps, vertical, rows, blocks, valid, radius)
        for k in range(0, len(rows), 1 << 14):
            w, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(words[k : k + (1 << 14)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield rows[k : k + (1 << 14)][w], blocks[k : k + (1 << 14)][w] * BLOCK + lane
        at = to


def linked_rows(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) rows: a forest over the rows within radius bits in the same group; rows are sorted by group."""
    row = np.arange(len(fps))
    label = row.copy()
    if len(fps) > 1:
        for i, j in pairs_sorted(fps, group, radius):
            _join(label, i, j)
    moved = np.flatnonzero(label != row)
    return moved, label[moved]


def link_sorted(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, fp) of that forest."""
    i, j = linked_rows(fps, group, radius)
    return fps[i], fps[j]


def _bands(radius: int, choose: int) -> list[int]:
    """A mask for each set of `choose` of the radius + choose bands of bits."""
    cuts = np.linspace(0, BITS, radius + choose + 1).astype(int)
    parts = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, choose)]


def scheme(n: int, radius: int) -> int:
    """How many bands must agree, so that a bucket of random fingerprints holds a few thousand at most."""
    choose = 1
    while choose < 8 and n / 2 ** (BITS * choose / (radius + choose)) > 4096:
        choose += 1
    return choose


def _dealt(keyed: DataFrame, split: int) -> DataFrame:
    """keyed (band, key and more) with p, q: rows of a bucket that holds more than one; over `split` rows it is cut into
    pieces, and each piece goes to a group (p, q) with every other one."""
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    k = F.ceil(F.col("n") / F.lit(split)).cast("int")
    own = keyed.join(sizes, ["band", "key"]).withColumn("_k", k).withColumn("_piece", F.pmod(F.xxhash64(F.lit(3), "fp", *keyed.columns[:1]), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_other")
    return own.select(*keyed.columns, "_piece", other).select(*keyed.columns, F.least("_piece", "_other").alias("p"), F.greatest("_piece", "_other").alias("q"))


def _by_groups(batches, columns: int, keys: slice):
    """The columns of whole groups (rows with the same keys, side by side) as int64 arrays, with the number of each row's group."""
    held: list = []

    def grouped(cols):
        k = np.stack(cols[keys], 1)
        return cols, np.r_[0, np.cumsum((k[1:] != k[:-1]).any(1))]

    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(columns)])
        cols = [np.concatenate(c) for c in zip(*held)]
        k = np.stack(cols[keys], 1)
        cut = len(k) - int(np.argmax((k[::-1] != k[-1]).any(1))) if (k[0] != k[-1]).any() else 0
        if cut:
            yield grouped([c[:cut] for c in cols])
        held = [[c[cut:].copy() for c in cols]]
    if held and len(held[0][0]):
        yield grouped(held[0])


def edges(classes: DataFrame, radius: int = 4, choose: int | None = None, split: int = SPLIT) -> DataFrame:
    """(u, v) long: a forest that links the distinct fingerprints (column fp) within radius bits."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be between 0 and 7")
    masks = _bands(radius, choose or scheme(classes.count(), radius))
    signed = [m - (1 << BITS) if m >> 63 else m for m in masks]
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("band", "key"))
    dealt = _dealt(keyed, split).repartition("band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q", "fp")

    def run(batches):
        for cols, group in _by_groups(batches, 5, slice(1, 5)):
            u, v = link_sorted(cols[0].view(np.uint64), group, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return dealt.select("fp", "band", "key", "p", "q").mapInArrow(run, "u long, v long")


def classes(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """fp, least (smallest id) and n of each distinct fingerprint."""
    return prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", shingle: int = 4, radius: int = 4, choose: int | None = None) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id that can be reached)."""
    prints = table(fingerprints(docs, id_col, shingle))
    distinct = table(classes(prints, id_col))
    roots = components(edges(distinct.select("fp"), radius, choose))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # only components of two classes or more need the second join
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _row_key():
    """As a key of its own, a row stands for its component even where others share its doc_id or have none; null ids come last."""
    r, q = row_keys("doc_id", "text")
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", r.alias("r"), q.alias("q")).alias("key")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept (r, q) names; repeated rows are one."""
    r, q = row_keys("doc_id", "text")
    own = kept.select(F.col("r").alias("_kr"), F.col("q").alias("_kq")).distinct()
    met = docs.withColumn("_r", r).withColumn("_q", q).join(own, (F.col("_r") == F.col("_kr")) & (F.col("_q") == F.col("_kq")), "left_semi")
    return met.dropDuplicates(["_r", "_q"]).drop("_r", "_q")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs for each component: of smallest doc_id, null last, then of smallest row hash; repeated rows are one."""
    found = near_duplicates(docs.select(_row_key(), "text"), "key", shingle, radius)
    return _only(docs, found.select("component_id.r", "component_id.q"))
