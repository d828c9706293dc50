"""Benchmark decontamination by latent semantic retrieval.

Every text is cut into blocks of HALF words; a passage is two neighbouring blocks. Blocks are TF-IDF vectors over 2^14
hashed words (document frequencies over all blocks). A randomised SVD of all blocks finds the leading right singular
vectors: each task multiplies its blocks with a random matrix and back (A'AX), the sums meet in one aggregate of fixed size, and one more
small decomposition gives vectors and singular values (one pass: A'A is about Y (X'Y)^-1 Y'). Passages and benchmark
items are projected on them, weighted by the inverse singular values, so that a frequent word or a language does not
make two texts alike. Cosines of all passages with all items, in blocks of ITEMS items, give candidates.

A candidate goes on if the passage with its surroundings has as many of the item's rarest words as a leak needs at
least (Telling; a true bound, which drops no leak). It is then checked on the words: the longest common subsequence of the item and the passage with its surroundings,
by bit-parallel dynamic programming. It is a leak if LEAK of the item's words are in it, or if PARAPHRASE are and the
answer (the item's answer column, else its last ANSWER words) is there whole and in order.

Words are lower-cased, ASCII punctuation is dropped; they are compared by their CRC-32. Texts are split and hashed once;
later passes read the numbers.

Defined results: a null or empty text, or an item without words, leaks nothing; repeated rows give repeated leaks; a null
doc_id is carried; items with the same text are found alike.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, frugal, row_keys, table

TERMS, RANK, HALF = 1 << 14, 64, 24
COSINE, LEAK, PARAPHRASE, ANSWER = 0.2, 0.7, 0.6, 6
#: The share of an item's words, the rarest, that are counted before a candidate's subsequence is; any value drops no leak.
TELLING = 0.6
ITEMS, GATHER, AT_ONCE = 1024, 8, 1 << 19
#: Words whose rows are gathered at once, few enough for the processor's cache.
CACHED = 1 << 12
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words(text: str | None) -> np.ndarray:
    found = (text or "").encode().translate(LOWER_BYTES, _PUNCTUATION).split()
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


def hashed_words(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, words: CRC-32 of each word as little-endian bytes)."""

    @frugal
    def run(batches):
        for b in batches:
            out = [words(x.as_py()).astype("<u4").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "words"])

    own = docs.select(id_col, "text")
    return own.mapInArrow(run, f"{id_col} {own.schema[id_col].dataType.simpleString()}, words binary")


class Blocks:
    """Some texts' words with the block that each lies in."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter((len(t) // 4 for t in texts), np.int64, len(texts))
        self.word = np.frombuffer(b"".join(texts), "<u4")
        self.first = np.r_[0, np.cumsum(size)]
        count = -(-size // HALF)
        self.first_block = np.r_[0, np.cumsum(count)]
        self.text = np.repeat(np.arange(len(texts)), count)
        self.starts = np.repeat(self.first[:-1] - self.first_block[:-1] * HALF, count) + np.arange(len(self.text)) * HALF
        self.block = np.repeat(np.arange(len(self.text)), np.diff(np.r_[self.starts, len(self.word)]))
        self.term = (self.word & np.uint32(TERMS - 1)).astype(np.int32)

    def slots(self, kind=np.uint16) -> np.ndarray:
        """(blocks, HALF) terms; TERMS where a block has no more words."""
        out = np.full((len(self.text), HALF), TERMS, kind)
        out[self.block, np.arange(len(self.word)) - self.starts[self.block]] = self.term
        return out

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """(blocks, width): the sums over each block's words of the rows (a row for each term)."""
        full = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
        out, slots, step = np.empty((len(self.text), rows.shape[1]), rows.dtype), self.slots(), CACHED // HALF
        for at in range(0, len(slots), step):
            out[at : at + step] = full[slots[at : at + step].T].sum(0)
        return out

    def add_to_terms(self, rows: np.ndarray, total: np.ndarray) -> None:
        """Adds to each term of total the rows (a row for each block) of its words."""
        order = np.argsort(self.term.astype(np.uint16), kind="stable")
        term, block = self.term[order], self.block[order]
        for at in range(0, len(term), CACHED):
            own = term[at : at + CACHED]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[starts]] += np.add.reduceat(rows[block[at : at + CACHED]], starts, axis=0)


def _chunks(batches, column: int, most: int = AT_ONCE * 4):
    """(batch slice, texts) with about `most` bytes each."""
    for b in batches:
        held, at, size = [], 0, 0
        for i, x in enumerate(b.column(column)):
            held.append(x.as_py())
            size += len(held[-1])
            if size >= most or i == b.num_rows - 1:
                yield b.slice(at, len(held)), held
                held, at, size = [], i + 1, 0


def document_frequencies(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """(blocks that have each term, all blocks)."""

    @frugal
    def run(batches):
        df, n = np.zeros(TERMS, np.int64), 0
        for _, texts in _chunks(batches, 0):
            b = Blocks(texts)
            n += len(b.text)
            slots = np.sort(b.slots(), axis=1)
            slots[:, 1:][slots[:, 1:] == slots[:, :-1]] = TERMS  # a block counts once
            df += np.bincount(slots.ravel(), minlength=TERMS + 1)[:TERMS]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], names=["term", "n"])

    got = hashed.select("words").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(TERMS, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def right_vectors(hashed: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(TERMS, rank): the idf-weighted right singular vectors of the blocks' TF-IDF matrix over their singular values."""
    spark = hashed.sparkSession
    probe = np.random.default_rng(11).standard_normal((TERMS, rank)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, probe * idf[:, None]))  # 4 MB
    names = [f"c{i}" for i in range(rank)]

    @frugal
    def run(batches):
        weight, weighted = shared.value
        total = np.zeros((TERMS, rank))
        for _, texts in _chunks(batches, 0):
            b = Blocks(texts)
            if not len(b.word):
                continue
            scale = 1 / np.maximum(np.add.reduceat(weight[b.term] ** 2, b.starts), 1e-9)  # of the squared norms: once for A, once for A'
            b.add_to_terms(b.sums(weighted) * scale[:, None], total)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, i]) for i in range(rank))], names=["term", *names])

    few = max(spark.sparkContext.defaultParallelism, -(-hashed.rdd.getNumPartitions() // GATHER))
    parts = hashed.select("words").coalesce(few).mapInArrow(run, "term int, " + ", ".join(f"{c} double" for c in names))
    got = parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    y = np.zeros((TERMS, rank))
    y[got["term"].to_numpy()] = np.stack([got[c].to_numpy() for c in names], 1)
    y *= idf[:, None]
    core = probe.T.astype(np.float64) @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    on = value > max(value.max(), 1e-12) * 1e-9
    if not on.any():
        return np.zeros((TERMS, 1), np.float32)
    left, single, _ = np.linalg.svd(y @ (vector[:, on] / np.sqrt(value[on])), full_matrices=False)
    return (left / np.maximum(single, 1e-9) * single.max() * idf[:, None]).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with a's positions as the bits of an integer."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        m = place.get(x)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def item_windows(items: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(item, from, to): an item longer than a passage is searched by its parts."""
    out = []
    for i, w in enumerate(items):
        parts = max(1, round(len(w) / (2 * HALF)))
        cuts = [len(w) * k // parts for k in range(parts + 1)]
        out += [(i, a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    return out


class Telling:
    """The items by their telling words, and the least number of them that a subsequence of `share` of an item holds.

    An item's telling words are its rarest, about TELLING of its length. A subsequence of `share` of the item leaves out
    1 - share of its words, so all telling words but that many are in it, and in any region of a text that holds it."""

    def __init__(self, items: list[np.ndarray], rarity: np.ndarray, share: float):
        words, owners = [], []
        self.needs = np.zeros(len(items), np.int64)
        for i, w in enumerate(items):
            own, times = np.unique(w, return_counts=True)
            order = np.argsort(-rarity[own & np.uint32(TERMS - 1)], kind="stable")
            size = np.cumsum(times[order])
            n = int(np.searchsorted(size, TELLING * len(w))) + 1
            words.append(own[order[:n]])
            owners.append(np.full(len(words[-1]), i))
            # the words outside of the telling ones may all be in the subsequence
            self.needs[i] = int(np.ceil(share * len(w) - 1e-9)) - (len(w) - int(size[min(n, len(size)) - 1]))
        number = np.concatenate([*words, np.zeros(0, np.uint32)])
        self.words, number = np.unique(number, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.items = np.concatenate([*owners, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.first = np.searchsorted(number[order], np.arange(len(self.words) + 1))
        self.maybe = np.zeros(TERMS, bool)
        self.maybe[self.words & np.uint32(TERMS - 1)] = True
        self.reach = np.array([-(-len(w) // HALF) for w in items], np.int64)

    def enough(self, b: Blocks) -> np.ndarray:
        """(blocks, items): whether a passage and as many words on each side as the item has can hold the item's share."""
        n, blocks = len(self.needs), len(b.text)
        some = np.flatnonzero(self.maybe[b.term])
        at = np.minimum(np.searchsorted(self.words, b.word[some]), len(self.words) - 1)
        on = self.words[at] == b.word[some]
        at, block = at[on], b.block[some[on]]
        first, count = self.first[at], self.first[at + 1] - self.first[at]
        end = np.cumsum(count)
        item = self.items[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(first - end + count, count)]
        have = np.bincount(np.repeat(block, count) * n + item, minlength=blocks * n).reshape(blocks, n)
        before = np.zeros((blocks + 1, n), np.int32)
        np.cumsum(have, axis=0, out=before[1:])
        out, row = np.empty((blocks, n), bool), np.arange(blocks)
        for reach in np.unique(self.reach):
            own = np.flatnonzero(self.reach == reach)
            low = np.maximum(row - reach, b.first_block[b.text])
            high = np.minimum(row + 2 + reach, b.first_block[b.text + 1])
            part = before[:, own]
            out[:, own] = part[high] - part[low] >= self.needs[own]
        return out


def search(hashed: DataFrame, vectors: np.ndarray, rarity: np.ndarray, items: list[tuple], cosine: float = COSINE, leak: float = LEAK, paraphrase: float = PARAPHRASE) -> DataFrame:
    """(doc_id, item_id, cosine, common, item_words) of the leaks. items: (item_id, words, answer words); rarity of each term."""
    texts = [w for _, w, _ in items]
    parts = item_windows(texts)
    rows = np.stack([vectors[texts[i][a:b] & np.uint32(TERMS - 1)].sum(0) for i, a, b in parts]) if parts else np.zeros((0, vectors.shape[1]), np.float32)
    shared = hashed.sparkSession.sparkContext.broadcast(pickle.dumps((vectors, rarity, items, parts, normed(rows))))  # ITEMS items at most
    id_kind, item_kind = hashed.schema["doc_id"].dataType.simpleString(), "long" if items and isinstance(items[0][0], int) else "string"

    @frugal
    def run(batches):
        v, rarity, items, parts, rows = pickle.loads(shared.value)
        telling = Telling([w for _, w, _ in items], rarity, min(leak, paraphrase))
        owner = np.array([i for i, _, _ in parts], np.int64)
        plain = [(w.tolist(), answer.tolist()) for _, w, answer in items]
        for piece, held in _chunks(batches, 1, AT_ONCE):
            b = Blocks(held)
            if not len(b.word) or not parts:
                continue
            one = b.sums(v)
            two = one.copy()
            two[:-1] += np.where((b.text[1:] == b.text[:-1])[:, None], one[1:], 0)
            best = np.maximum(normed(one) @ rows.T, normed(two) @ rows.T)
            block, part = np.nonzero((best >= cosine) & telling.enough(b)[:, owner])
            found: dict = {}
            ends = np.r_[b.starts, len(b.word)]
            last = np.minimum(np.arange(len(b.text)) + 2, b.first_block[b.text + 1])
            for k, p in zip(block.tolist(), part.tolist()):
                t, item = int(b.text[k]), parts[p][0]
                w, answer = plain[item]
                near_from, near_to = max(b.first[t], b.starts[k] - len(w)), min(b.first[t + 1], ends[last[k]] + len(w))
                region = b.word[near_from:near_to].tolist()
                common = common_subsequence(w, region)
                if common >= leak * len(w) or common >= paraphrase * len(w) and answer and common_subsequence(answer, region) == len(answer):
                    old = found.get((t, item), (0.0, 0))
                    found[t, item] = (max(old[0], float(best[k, p])), max(old[1], common))
            if found:
                keys = sorted(found)
                cols = [piece.column(0).take(pa.array([t for t, _ in keys])), pa.array([items[i][0] for _, i in keys])]
                cols += [pa.array([found[k][0] for k in keys]), pa.array([found[k][1] for k in keys], pa.int32()), pa.array([len(plain[i][0]) for _, i in keys], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "cosine", "common", "item_words"])

    return hashed.select("doc_id", "words").mapInArrow(run, f"doc_id {id_kind}, item_id {item_kind}, cosine double, common int, item_words int")


def leaks(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, common, item_words): each document that an item has leaked into."""
    spark = docs.sparkSession
    hashed = table(hashed_words(docs))
    df, n = document_frequencies(hashed)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1e-3)
    vectors = right_vectors(hashed, idf)
    out, block = None, []

    def flush():
        nonlocal out, block
        part = search(hashed, vectors, idf, block, cosine)
        out, block = part if out is None else out.unionAll(part), []

    chosen = benchmark.select("item_id", "text", *([answer_col] if answer_col else []))
    for r in chosen.toLocalIterator():  # the stated query set, block by block
        w = words(r.text)
        if len(w):
            answer = words(r[answer_col]) if answer_col else w[-ANSWER:]
            block.append((r.item_id, w, answer))
        if len(block) == ITEMS:
            flush()
    if block or out is None:
        flush()
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item has leaked into. Rows are told apart by two hashes of doc_id and text, so those that
    share a doc_id, or have none, stand for themselves."""
    r, q = row_keys("doc_id", "text")
    own = docs.select(F.struct(r.alias("r"), q.alias("q")).alias("doc_id"), "text")
    bad = leaks(own, benchmark).select(F.col("doc_id.r").alias("_r"), F.col("doc_id.q").alias("_q")).distinct()
    return docs.join(bad, (r == F.col("_r")) & (q == F.col("_q")), "left_anti")
