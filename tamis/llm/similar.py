"""Near duplicates by word-shingle similarity: SimHash comparison for candidates, exact Jaccard similarity for links.

Two texts are linked if the sets of their word shingles have a Jaccard similarity of `least` or more. One pass over the
texts gives each its set (32-bit hashes), the set's SimHash fingerprint and BANDS keys, each of ROWS_PER_BAND least
hashes; at a similarity of 0.8 a pair shares a key with a probability of 0.9992. Texts with the same set are one class.
In a bucket, fingerprints meet bit-sliced (simhash.py), and a forest over those within RADIUS bits leaves it; at a
similarity of 0.8 the distance has a mean of 10 bits and a deviation of 3. The forests' components are candidates.

Each set is then sent to its component once (one over PIECE bytes is cut into pieces that meet two by two), where the
links are checked exactly: an inverted index of shingles gives a set's common shingles with all others at once. Sets
that are linked need no further check against each other, so only those outside of the largest linked group are looked
up: n copies of one text take one lookup. A forest of the checked links leaves the task, never all pairs.

Defined results: null, empty and wordless texts are one class, texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, drop_table, frugal, table
from .components import components
from .grams import pieces
from .simhash import BITS, SPLIT, _by_groups, _dealt, _join, _only, _row_key, linked_rows

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS_PER_BAND, RADIUS = 10, 3, 20
#: Bytes of sets of a component that go to a task together.
PIECE = 8_000_000


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 hashes (seed 42) of the text's word shingles; A-Z count as a-z."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :]
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _keys(bands: int, rows: int):
    rng = np.random.default_rng(5)
    factor = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) | np.uint64(1)
    fold = rng.integers(1, 1 << 62, rows, dtype=np.uint64) | np.uint64(1)

    def keys(hashes: np.ndarray) -> np.ndarray:
        least = np.empty(bands * rows, np.uint64)
        for k, f in enumerate(factor):
            x = hashes * f
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x9E3779B97F4A7C15)
            least[k] = x.min()
        return (least.reshape(bands, rows) * fold).sum(1, dtype=np.uint64).view(np.int64)

    return keys


def sketches(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """key (of the row), r, q (hashes of the set), fp, bands and set (32-bit hashes as bytes) of every row of docs."""
    own = docs.select(_row_key(), "text")
    kind = own.schema["key"].dataType.simpleString()

    @frugal
    def run(batches):
        keys = _keys(bands, rows)
        for b in batches:
            for part in pieces(b, 1, 2_000_000):
                found = [shingles(x.as_py(), width) for x in part.column(1)]
                r, q = (np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), seed) for h in found), np.uint64, len(found)).view(np.int64) for seed in (1, 2))
                fp = np.fromiter((majority(h) for h in found), np.uint64, len(found)).view(np.int64)
                band = [keys(h).tolist() if len(h) else [] for h in found]
                sets = [np.unique(h.astype(np.uint32)).tobytes() for h in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(r), pa.array(q), pa.array(fp), pa.array(band, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["key", "r", "q", "fp", "bands", "set"])

    return own.mapInArrow(run, f"key {kind}, r long, q long, fp long, bands array<long>, set binary")


def _candidates(dealt: DataFrame, radius: int) -> DataFrame:
    """u, v: a forest over the classes of each bucket whose fingerprints are within radius bits."""
    own = dealt.select("node", "fp", "band", "key", "p", "q").repartition("band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q", "node")

    @frugal
    def run(batches):
        for cols, group in _by_groups(batches, 6, slice(2, 6)):
            i, j = linked_rows(cols[1].view(np.uint64), group, radius)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][i]), pa.array(cols[0][j])], names=["u", "v"])

    return own.mapInArrow(run, "u long, v long")


def similar_sets(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): a forest over the sets (sorted distinct numbers) whose Jaccard similarity is `least` or more."""
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.r_[0, np.cumsum(size)]
    order = np.argsort(shingle, kind="stable")
    owner = np.repeat(np.arange(n), size)[order]
    posts = np.searchsorted(shingle[order], np.arange(int(shingle.max()) + 2 if len(shingle) else 1))
    label, looked = np.arange(n), np.zeros(n, bool)
    while True:
        # every pair that is not linked has an end outside of the largest group
        sizes = np.bincount(label, minlength=n)
        left = np.flatnonzero((label != sizes.argmax()) & ~looked) if looked.any() else np.zeros(1, np.int64)
        if not len(left):
            break
        i = int(left[0])
        looked[i] = True
        own = shingle[first[i] : first[i + 1]]
        count = posts[own + 1] - posts[own]
        end = np.cumsum(count)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(posts[own] - end + count, count)
        both = np.bincount(owner[at], minlength=n)
        near = np.flatnonzero(both >= least * (size[i] + size - both) - 1e-9)
        near = near[label[near] != label[i]]
        _join(label, np.full(len(near), i), near)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _verified(dealt: DataFrame, least: float) -> DataFrame:
    """u, v: a forest of the links between the sets of each group (root, p, q)."""
    own = dealt.select("node", "set", "root", "p", "q").repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "node")

    @frugal
    def run(batches):
        def out():
            if len(nodes) > 1:
                i, j = similar_sets(sets, least)
                node = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])

        nodes, sets, now = [], [], None
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in (2, 3, 4))))
            for node, x, key in zip(b.column(0).to_pylist(), b.column(1), keys):
                if key != now:
                    yield from out()
                    nodes, sets, now = [], [], key
                nodes.append(node)
                sets.append(np.frombuffer(x.as_py(), np.uint32))
        yield from out()

    return own.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, width: int = SHINGLE, least: float = LEAST, bands: int = BANDS, rows: int = ROWS_PER_BAND, radius: int = RADIUS, split: int = SPLIT, piece: int = PIECE) -> DataFrame:
    """key, component (the smallest key that can be reached) of every row of docs. key: of the row, see simhash.keep_one."""
    spark = docs.sparkSession
    made = table(sketches(docs, width, bands, rows))
    # the texts of one set are summed before anything else; a class is numbered once it is written
    own = table(made.groupBy("r", "q").agg(F.min("key").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    near = components(_candidates(_dealt(own.select("node", "fp", F.posexplode("bands").alias("band", "key")), split), radius))
    sets = table(near.join(own.select("node", "r", "q", "least"), "node").join(made.select("r", "q", F.col("key").alias("least"), "set"), ["r", "q", "least"]).groupBy("node", "root").agg(F.first("set").alias("set")))
    k = F.ceil(F.sum(F.length("set") + 64) / piece).cast("int").alias("_k")
    cut = sets.join(sets.groupBy("root").agg(k), "root").withColumn("_piece", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_other")
    dealt = cut.select("node", "set", "root", "_piece", other).withColumn("p", F.least("_piece", "_other")).withColumn("q", F.greatest("_piece", "_other"))
    labels = components(_verified(dealt, least)).withColumnRenamed("root", "label")
    rooted = table(own.select("r", "q", "node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    named = rooted.join(rooted.groupBy("label").agg(F.min("least").alias("component")), "label").select("r", "q", "component")
    out = table(made.select("key", "r", "q").join(named, ["r", "q"]).select("key", "component"))
    for old in (made, own, sets, rooted):
        drop_table(spark, old)
    return out


def keep_one(docs: DataFrame, width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of docs for each component: of smallest doc_id, null last, then of smallest row hash; repeated rows are one."""
    found = classes(docs, width, least)
    return _only(docs, found.select("component.r", "component.q"))
