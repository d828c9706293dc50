"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end per text. Their training counts give the base model (add one) and a tree of
three levels with `width` branches each: a class, a class in it, a leaf. The most frequent words have a leaf of their
own, the words side by side in byte order, so that a class holds words that begin alike; every other word, seen or not,
lies in one of the last class's leaves, chosen by its ending. P(token | context) = P(class | context)
P(class in it | class, context) P(leaf | both, context) P(token | leaf); the last is (c + 1) / (sum of c + 1 in the leaf,
plus 1 for all words never seen). The others are maximum-entropy models over hashed features of the three tokens before,
by their words: the token before, the skips over one and two tokens, the pair before, and the ending before. Features of
all levels share one table of rows of `width` weights. They start as the unigram model, so features only refine it.

What is learned grows with the corpus: branches with the sixth root of the distinct words (so leaves with their square
root), rows with the tokens to the power 0.4, training shards with the square root of the tokens.

Training: every training text is used once. Texts are dealt to shards by a hash, so the model is the same on every
cluster; a shard's task runs AdaGrad over its texts in minibatches from the common start and returns the change of each
row. Changes are averaged row by row, weighted by how often a shard met the row, in ROUNDS rounds: the second part of the
shards starts from what the first has learned. The KNOWN most frequent words are broadcast with their counts (a bound on
the list, not on what is counted); words beyond meet their counts in a join, so counts are exact for every token.

Defined results: a null or empty text is one end token; a null doc_id trains; repeated rows count and are scored each;
with no training texts all counts are zero.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, row_keys, table
from .grams import pieces

KNOWN = 200_000
BATCH, RATE = 8192, 0.2
#: Rounds of averaging, and rows of the table that travel together.
ROUNDS, TOGETHER = 2, 256
END = None
#: Words beyond the known ones that a task remembers.
REMEMBERED = 100_000
#: Distinct words that a task counts before it hands its counts on, and rows of an Arrow batch.
COUNTED, SLICE = 100_000, 20_000
#: Occurrences of a row in a batch that are added one rank at a time; those beyond, of few rows, by segment.
RANKS = 8
#: Tokens, or rows of the table, whose weights are in hand at once, so that they stay in a core's cache.
CHUNK = 2048
#: Logits are kept within these bounds, far beyond what training reaches, so that sums of 32-bit exponentials stay finite.
_MOST = np.float32(60)
#: Before a text's first token.
_START = 0x9E3779B9


@dataclass(frozen=True)
class Shape:
    """The size of a model."""

    width: int
    rows: int
    shards: int

    @classmethod
    def of(cls, tokens: int, distinct: int) -> Shape:
        width = max(8, -(-round((4 * distinct**0.5) ** (1 / 3)) // 4) * 4)
        rows = 1 << max(10, round(np.log2(100 * max(tokens, 1) ** 0.4)))
        return cls(width, rows, max(ROUNDS, round(tokens**0.5 / 450)))

    @property
    def leaves(self) -> int:
        return self.width**3

    @property
    def own(self) -> int:
        """Leaves of one word; the last class is for all other words."""
        return (self.width - 1) * self.width**2


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_in(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(the number of every word among the distinct ones, these by their first place, the words of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded, sizes = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    index, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    if b"" in words:  # before or after white space at a text's end
        empty = words.index(b"")
        del words[empty]
        kept, ends = index != empty, np.cumsum(sizes)
        until = np.r_[0, np.cumsum(kept)]
        index, sizes = index[kept], until[ends] - until[ends - sizes]
        index = index - (index > empty)
    return index, words, sizes


def token_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word binary, c): the words of all rows; the end is a null word."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            entries = iter(seen.items())
            while some := list(islice(entries, SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names=["word", "c"])

        for b in batches:
            for part in pieces(b, 0, 1_000_000):
                seen[END] += part.num_rows
                index, words, _ = words_in(part.column(0))
                seen.update(dict(zip(words, np.bincount(index, minlength=len(words)).tolist())))
                if len(seen) > COUNTED:
                    yield from out()
                    seen = Counter()
        yield from out()

    return texts.select(column).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


@dataclass
class Vocabulary:
    """What is known of the counts: N, V, the KNOWN most frequent words with counts and leaves, and each leaf's mass."""

    tokens: int
    distinct: int
    shape: Shape
    words: list
    counts: np.ndarray
    leaves: np.ndarray
    mass: np.ndarray
    index: dict = field(default_factory=dict)

    def ranks(self) -> dict:
        if not self.index:
            self.index = {w: i for i, w in enumerate(self.words)}
        return self.index

    def leaf(self, word) -> int:
        rank = self.ranks().get(word, -1)
        return int(self.leaves[rank]) if 0 <= rank < len(self.leaves) else self.rare_leaf(word)

    def rare_leaf(self, word: bytes) -> int:
        return self.shape.own + zlib.crc32(word[-3:]) % self.shape.width**2

    def __getstate__(self):
        return self.__dict__ | {"index": {}}


def vocabulary(counts: DataFrame, known: int | None = None) -> Vocabulary:
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    shape = Shape.of(int(totals.n), int(totals.v))
    known = known or max(KNOWN, shape.own)
    # the greatest steps of log counts that hold `known` words together: the list is bounded before anything is sent
    step = F.floor(F.log("c") * 60).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r.n
        if held > known:
            break
        least = r.s
    top = counts.where((step >= least) | F.col("word").isNull()).toArrow()
    # the end first: it always has a leaf; then by count and, for equal counts, the word itself
    best = sorted((w is not END, -n, w or b"") for w, n in zip(top["word"].to_pylist(), top["c"].to_pylist()))
    if not best or best[0][0]:
        best.insert(0, (False, 0, b""))
    words, c = [END] + [w for _, _, w in best[1:]], np.array([-n for _, n, _ in best], np.int64)
    own = min(len(words), shape.own)
    # the words with a leaf lie in byte order, spread over the classes
    leaves = np.empty(own, np.int32)
    leaves[sorted(range(own), key=lambda i: words[i] or b"")] = np.arange(own, dtype=np.int64) * shape.own // max(own, 1)
    mass = np.zeros(shape.leaves)
    mass[leaves] = c[:own] + 1
    mass[shape.own :] = 1
    few = counts.sparkSession.createDataFrame([(w,) for w in words[1:own]], "word binary")
    left = counts.where("word is not null").join(F.broadcast(few), "word", "left_anti")  # a word for each leaf at most
    ending = F.expr(f"crc32(substring(word, greatest(length(word) - 2, 1), 3)) % {shape.width**2}")
    for r in left.groupBy(ending.alias("leaf")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[shape.own + r.leaf] += r.m
    return Vocabulary(int(totals.n), int(totals.v), shape, words, c, leaves, mass)


class Reader:
    """Turns texts into numbers of words, with what is needed of each word: hash, leaf, rank and count.

    The known words' numbers are their ranks; others are numbered as they come and forgotten when there are too many."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.most_rare = v, len(v.words), np.uint32(v.shape.width**2)
        own = len(v.leaves)
        leaf = np.r_[v.leaves, self._rare(v.words[own:])].astype(np.int32)
        hashes = np.r_[np.uint32(1), self._hashes(v.words[1:])]  # the end comes first
        self.of_known = hashes, leaf, np.log10(v.counts + 1), np.arange(self.known, dtype=np.int64)
        self.forget()

    def _rare(self, words: list) -> np.ndarray:
        return self.v.shape.own + (self._hashes([w[-3:] for w in words]) % self.most_rare).astype(np.int32)

    def _hashes(self, words: list) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))

    def forget(self):
        self.number = defaultdict(count(self.known).__next__, zip(self.v.words, range(self.known)))
        self.hash, self.leaf, self.log, self.rank = self.of_known

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all tokens; first token of each text and the end)."""
        if len(self.number) > self.known + REMEMBERED:
            self.forget()
        number = self.number
        index, words, sizes = words_in(texts)
        first = np.r_[0, np.cumsum(sizes + 1)]
        flat, word = np.zeros(int(first[-1]), np.int32), np.ones(int(first[-1]), bool)  # the end's number is 0
        word[first[1:] - 1] = False
        flat[word] = np.fromiter(map(number.__getitem__, words), np.int32, len(words)).take(index)
        if len(number) > len(self.leaf):
            new = list(islice(number, len(self.leaf), None))
            self.hash, self.leaf = np.r_[self.hash, self._hashes(new)], np.r_[self.leaf, self._rare(new)]
            self.log, self.rank = np.r_[self.log, np.zeros(len(new))], np.r_[self.rank, np.full(len(new), -1)]
        return flat, first


def features(word: np.ndarray, leaf: np.ndarray, first: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """Rows of the table for each level: (5 x tokens) for the class, (3 x tokens) for the class in it, (2 x tokens) for the leaf."""
    bits = np.uint64(64 - int(shape.rows).bit_length() + 1)
    place = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))

    def before(values, k, start):
        x = np.full(len(values), start, np.uint64)
        x[k:] = values[:-k] if len(values) > k else values[:0]
        x[place < k] = start
        return x

    def row(kind, *parts):
        h = np.full(len(word), (kind * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (1 << 64) - 1, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> bits).astype(np.int32)

    a, b, c = (before(word, k, _START) for k in (1, 2, 3))
    ending = before(leaf, 1, shape.leaves)
    top, mid = (leaf // shape.width**2).astype(np.uint64), (leaf // shape.width).astype(np.uint64)
    return [
        np.stack([row(0, a), row(1, b), row(2, c), row(3, a, b), row(4, ending)]),
        np.stack([row(5, a, top), row(6, b, top), row(7, ending, top)]),
        np.stack([row(8, a, mid), row(9, ending, mid)]),
    ]


@dataclass
class Model:
    shape: Shape
    weights: np.ndarray
    bias: list

    @classmethod
    def unigram(cls, shape: Shape, mass: np.ndarray) -> Model:
        k, m = shape.width, np.maximum(mass, 1e-3).reshape(-1, shape.width)
        bias = []
        for _ in range(3):
            share = m.sum(1)
            bias.insert(0, np.log(m / share[:, None]).astype(np.float32))
            m = share.reshape(-1, k) if len(share) > 1 else share
        return cls(shape, np.zeros((shape.rows, k), np.float32), bias)

    def logits(self, rows: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        z = self.bias[level].take(node, 0) if level else np.repeat(self.bias[0], rows.shape[1], 0)
        for r in rows:
            z += self.weights.take(r, 0)
        return z

    def steps(self, leaf: np.ndarray):
        """(level, node, branch) of each of the three decisions."""
        k = self.shape.width
        return (0, np.zeros(len(leaf), np.int64), leaf // (k * k)), (1, leaf // (k * k), leaf // k % k), (2, leaf // k, leaf % k)

    def log_prob(self, word: np.ndarray, leaf: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log of P(leaf | context) for each token."""
        found, out = features(word, leaf, first, self.shape), np.zeros(len(leaf))
        for at in range(0, len(leaf), CHUNK):
            s = slice(at, at + CHUNK)
            row = np.arange(len(leaf[s]))
            for level, node, branch in self.steps(leaf[s]):
                out[s] += _log_softmax_at(self.logits(found[level][:, s], level, node), row, branch)
        return out


def _log_softmax_at(z, row, col):
    np.clip(z, -_MOST, _MOST, out=z)
    own = z[row, col].astype(np.float64)
    np.exp(z, out=z)
    return own - np.log((z @ np.ones(z.shape[1], z.dtype)).astype(np.float64))


def _softmax_loss(z, row, col):
    np.clip(z, -_MOST, _MOST, out=z)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    z[row, col] -= 1
    return z


def _sums(gradient, token, at, size):
    """The sums of gradient[token] by segment; they start at `at`, the longest first.

    Most segments are short, so they are added one rank of their members at a time."""
    out = gradient.take(token.take(at), 0)
    longer = np.searchsorted(-size, -np.arange(1, RANKS + 1), "left")  # segments of more than 1, 2, ... members
    for j, m in enumerate(longer[:-1].tolist(), 1):
        if not m:
            break
        out[:m] += gradient.take(token.take(at[:m] + j), 0)
    if m := int(longer[-1]):
        left = size[:m] - RANKS
        first = np.cumsum(left) - left
        place = np.repeat(at[:m] + RANKS - first, left) + np.arange(int(left.sum()))
        out[:m] += np.add.reduceat(gradient.take(token[place], 0), first, axis=0)
    return out


def _order(rows: np.ndarray, most: int) -> np.ndarray:
    """A stable order of numbers below `most`, 16 bits at a time: a radix sort."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    if most > 1 << 16:
        order = order[np.argsort((rows[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _descend(weights, squares, rows, gradient, rate):
    """AdaGrad with one step size per row: rows (k x n) of weights take the gradient (n x width) of their tokens."""
    flat = rows.ravel()
    order = _order(flat, len(weights))
    sorted_ = flat.take(order)
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    token = np.tile(np.arange(len(gradient), dtype=np.int32), len(rows)).take(order)
    size = np.diff(np.r_[starts, len(token)])
    by = np.argsort((-size).astype(np.int16), kind="stable")
    at, size = starts.take(by), size.take(by)
    whole = f"V{weights.itemsize * weights.shape[1]}"  # rows are put back as one element each
    for k in range(0, len(at), CHUNK):
        some = at[k : k + CHUNK]
        g, used = _sums(gradient, token, some, size[k : k + CHUNK]), sorted_.take(some)
        total = squares.take(used) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        squares[used] = total
        g *= (rate / np.sqrt(total))[:, None]
        np.subtract(weights.take(used, 0), g, out=g)
        weights.view(whole)[used, 0] = g.view(whole)[:, 0]


def train_on(model: Model, word: np.ndarray, leaf: np.ndarray, first: np.ndarray, squares: np.ndarray, met: np.ndarray, rate: float = RATE) -> None:
    """Takes the tokens in batches; met counts how often each row was used."""
    found = features(word, leaf, first, model.shape)
    for rows in found:
        met += np.bincount(rows.ravel(), minlength=len(met))
    for at in range(0, len(leaf), BATCH):
        s = slice(at, at + BATCH)
        row, n = np.arange(CHUNK), len(leaf[s])
        for level, node, branch in model.steps(leaf[s]):
            rows, gradient = found[level][:, s], np.empty((n, model.shape.width), np.float32)
            for k in range(0, n, CHUNK):
                c = slice(k, min(k + CHUNK, n))
                gradient[c] = _softmax_loss(model.logits(rows[:, c], level, node[c]), row[: c.stop - k], branch[c])
            _descend(model.weights, squares, rows, gradient, rate)


def _learn(dealt: DataFrame, v: Vocabulary, start: Model) -> Model:
    """start, moved by what the shards of dealt (text), one partition each, learn from it."""
    shared = dealt.sparkSession.sparkContext.broadcast(pickle.dumps((v, start)))
    width = start.shape.width

    def run(batches):
        known, model = pickle.loads(shared.value)
        began, reader = model.weights.copy(), Reader(known)
        squares, met = np.ones(len(began), np.float32), np.zeros(len(began), np.int64)
        for b in batches:
            for part in pieces(b, 0, 2_000_000):
                numbers, first = reader.tokens(part.column(0))
                train_on(model, reader.hash[numbers], reader.leaf[numbers], first, squares, met)
        for at in range(0, len(began), TOGETHER):
            on = np.flatnonzero(met[at : at + TOGETHER])
            if len(on):
                change = (model.weights[at + on] - began[at + on]).astype(np.float16)
                cols = [pa.array([at], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (on.astype(np.uint8), met[at + on], change))]
                yield pa.RecordBatch.from_arrays(cols, names=["at", "on", "met", "change"])

    def add(group: pa.Table) -> pa.Table:  # a row for each shard that met some of TOGETHER rows
        n, total = np.zeros(TOGETHER, np.int64), np.zeros((TOGETHER, width))
        for x, y, z in zip(group["on"], group["met"], group["change"]):
            on, met = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.int64)
            n[on] += met
            total[on] += np.frombuffer(z.as_py(), np.float16).reshape(-1, width) * met[:, None].astype(np.float64)
        mean = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
        return pa.table({"at": group["at"].slice(0, 1), "change": pa.array([mean.tobytes()], pa.binary())})

    changes = dealt.mapInArrow(run, "at int, on binary, met binary, change binary")
    for r in changes.groupBy("at").applyInArrow(add, "at int, change binary").toLocalIterator():
        mean = np.frombuffer(r.change, np.float32).reshape(-1, width)
        start.weights[r.at : r.at + len(mean)] += mean
    shared.destroy()
    return start


def train(texts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Distributed gradient updates over all texts (doc_id, text), each used once."""
    model = Model.unigram(v.shape, v.mass)
    h, g = row_keys("doc_id", "text")
    each = -(-v.shape.shards // rounds)
    own = texts.select("text", h.alias("h"), F.pmod(g, F.lit(rounds)).alias("round"))
    for k in range(rounds):
        # a shard's texts come in the order of their hash, whatever the files and the cluster; a session that deals to more
        # partitions doesn't make more shards
        dealt = own.where(F.col("round") == k).repartition(each, "h").sortWithinPartitions("h").select("text").coalesce(each)
        model = _learn(dealt, v, model)
    return model


def score(docs: DataFrame, v: Vocabulary, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps((v, model)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "word", "n", "known", "log_counts", "log_model"]

    def run(batches):
        known, m = pickle.loads(shared.value)
        reader, row = Reader(known), TaskContext.get().partitionId() << 33
        own = known.shape.own
        log_mass = np.where(np.arange(known.shape.leaves) >= own, np.log10(np.maximum(known.mass, 1)), 0.0)
        for b in batches:
            for part in pieces(b, 1, 2_000_000):
                ids = part.column(0)
                numbers, first = reader.tokens(part.column(1))
                leaf, rank, log = reader.leaf[numbers], reader.rank[numbers], reader.log[numbers]
                each = m.log_prob(reader.hash[numbers], leaf, first) / np.log(10) + np.where(leaf >= own, log, 0.0) - log_mass[leaf]
                sums = [np.add.reduceat(x, first[:-1]) for x in (((rank >= 0) & (known.counts[rank] > 0)).astype(np.int64), log, each)]
                rows = row + np.arange(len(ids))
                row += len(ids)
                cols = [pa.array(rows), ids, pa.nulls(len(ids), pa.binary()), pa.array(np.diff(first)), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                # words beyond the list, once per text: their counts come by the join
                far = np.flatnonzero(rank < 0)
                if len(far):
                    where = np.repeat(rows, np.diff(first))[far]
                    pair, n = np.unique((where - rows[0]) * len(reader.leaf) + numbers[far], return_counts=True)
                    words = list(reader.number)
                    for k in range(0, len(pair), SLICE):
                        p, zero = pair[k : k + SLICE], np.zeros(len(pair[k : k + SLICE]))
                        cols = [pa.array(rows[0] + p // len(reader.leaf)), pa.nulls(len(p), ids.type), pa.array([words[i] for i in (p % len(reader.leaf)).tolist()], pa.binary()), pa.array(n[k : k + SLICE].astype(np.int64))]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], names=names)

    made = table(docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, word binary, n long, known long, log_counts double, log_model double"))
    met = made.where("word is not null").select("row", "word", "n").join(counts.where("word is not null"), "word")
    beyond = met.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"))
    all_ = made.where("word is null").join(beyond, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return all_.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + log - F.col("n") * F.lit(float(np.log10(v.tokens + v.distinct + 1)))).alias("base_score"),
        (F.col("log_model") + log).alias("score"),
    )


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out, and scores all."""
    training = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    counts = table(token_counts(training))
    v = vocabulary(counts)
    out = table(score(docs, v, train(training, v), counts))
    drop_table(docs.sparkSession, counts)
    return out
