"""Byte-level BPE over a corpus by merge replay, from a file of ranks.

A task takes a window of its texts (WINDOW_CHARS, or WINDOW_WORDS new words), splits them by the pattern and replays the
merges once over all distinct words of the window that it has not met before. The words' bytes lie in one array with
left and right neighbours. An inverted index leads from the rank of a pair to the positions where the pair stands. Ranks
are taken in ascending order; a merge touches only the positions in its list, and only their two neighbours get new
entries. A rank whose merge could make a pair of lower rank is applied to the first position of each word only, so the
order is the same as if each word were encoded alone; a lower rank that appears is taken next. A word that is in the
vocabulary as a whole is its own id.

No shuffle: texts stay where they are read, and what a task holds is bounded by its window.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import frugal

#: The white space of Unicode, and the pattern of the vocabulary with it written out.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
WINDOW_CHARS = 24_000_000
WINDOW_WORDS = 400_000
#: Words that a worker remembers between windows.
REMEMBERED = 600_000
NONE = np.int32(2**31 - 1)
_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """The tokens of a rank file and, for each pair of tokens that can merge, the rank of the merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        n, get = len(self.tokens), self.ranks.get
        found = [
            (p * n + q, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (p := get(token[:cut])) is not None and (q := get(token[cut:])) is not None
        ]
        found.sort()
        self.keys = np.array([k for k, _ in found], np.int64)
        self.values = np.array([r for _, r in found], np.int32)
        lowest = np.full(n, NONE, np.int32)
        for part in (self.keys // n, self.keys % n):
            np.minimum.at(lowest, part, self.values)
        #: Ranks after whose merge no pair of lower or equal rank can appear.
        self.settled = lowest > np.arange(n)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def replay(v: Vocabulary, words: list[bytes], step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, ids per word)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    n = int(size.sum())
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    # one position more at the end, of no word, takes what points beyond
    sym = np.r_[v.first[np.frombuffer(b"".join(words), np.uint8)], np.int32(0)]
    right = np.arange(1, n + 2, dtype=np.int32)
    left = np.arange(-1, n, dtype=np.int32)
    ends = np.cumsum(size) - 1
    right[ends[size > 0]] = n
    left[(ends - size + 1)[size > 0]] = n
    right[n] = left[n] = n
    alive = np.ones(n + 1, bool)
    rank = np.full(n + 1, NONE, np.int32)
    inner = np.flatnonzero(right[:n] != n)
    rank[inner] = v.pair_ranks(sym[inner], sym[right[inner]])
    known = np.fromiter((v.ranks.get(w, -1) for w in words), np.int32, len(words))
    whole = (known >= 0) & (size > 1)
    rank[:n][whole[word]] = NONE
    alive[:n][whole[word]] = False
    heads = (ends - size + 1)[whole]
    alive[heads], sym[heads] = True, known[whole]
    at = np.flatnonzero(rank != NONE).astype(np.int32)
    waiting = [(rank[at], at)]
    for low in range(0, len(v.tokens), step):
        high = low + step
        r, p = (np.concatenate(x) for x in zip(*waiting)) if waiting else (np.zeros(0, np.int32),) * 2
        now = r < high
        waiting = [(r[~now], p[~now])]
        r, p = r[now], p[now]
        order = np.argsort(r, kind="stable")
        r, p = r[order], p[order]
        cut = np.flatnonzero(np.diff(r)) + 1
        index = {int(r[i]): [x] for i, x in zip((0, *cut.tolist()), np.split(p, cut))} if len(r) else {}
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            this = heapq.heappop(queue)
            p = index.pop(this, None)
            if p is None:
                continue
            p = np.concatenate(p) if len(p) > 1 else p[0]
            p = p[rank[p] == this]
            if len(p) > 1:
                p = np.unique(p)
                if v.settled[this]:
                    follows = np.r_[False, p[1:] == right[p[:-1]]]
                    if follows.any():  # of a chain of overlapping pairs, every other one
                        k = np.arange(len(p))
                        p = p[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
                else:
                    head = np.r_[True, word[p[1:]] != word[p[:-1]]]
                    if not head.all():
                        index[this] = [p[~head]]
                        heapq.heappush(queue, this)
                        p = p[head]
            if not len(p):
                continue
            gone = right[p]
            after = right[gone]
            sym[p] = this
            alive[gone] = False
            rank[gone] = NONE
            right[p] = after
            left[after] = p
            left[n] = n
            before = left[p]
            new = v.pair_ranks(sym[p], sym[after])
            new[after == n] = NONE
            rank[p] = new
            old = v.pair_ranks(sym[before], sym[p])
            old[before == n] = NONE
            rank[before] = old
            rank[n] = NONE
            r, q = np.r_[new, old], np.r_[p, before]
            some = r != NONE
            r, q = r[some], q[some]
            soon = r < high
            if soon.any():
                late = ~soon
                for a, b in zip(r[soon].tolist(), q[soon].tolist()) if soon.sum() < 8 else _grouped(r[soon], q[soon]):
                    b = np.array([b], np.int32) if isinstance(b, int) else b
                    if a in index:
                        index[a].append(b)
                    else:
                        index[a] = [b]
                        heapq.heappush(queue, a)
                r, q = r[late], q[late]
            if len(r):
                waiting.append((r, q))
    out = alive[:n]
    return sym[:n][out], np.bincount(word[out], minlength=len(words))


def _grouped(r: np.ndarray, q: np.ndarray):
    order = np.argsort(r, kind="stable")
    r, q = r[order], q[order]
    cut = np.flatnonzero(np.diff(r)) + 1
    return zip(r[np.r_[0, cut]].tolist(), np.split(q, cut))


class Encoder:
    """Encodes windows of texts and remembers the words that it has met."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.v = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Replays the merges over the words of the index that have no ids yet."""
        new = list(self.index)[len(self.start) :]
        if new:
            ids, count = replay(self.v, [w.encode() for w in new])
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])

    def words(self, text: str) -> np.ndarray:
        """The numbers of a text's words; new words get the next ones."""
        found, index = self.split(text), self.index
        try:
            return np.fromiter(map(index.__getitem__, found), np.int32, len(found))
        except KeyError:
            put = index.setdefault
            return np.fromiter([put(w, len(index)) for w in found], np.int32, len(found))

    def encode(self, words: np.ndarray) -> np.ndarray:
        """The ids of a text from the numbers of its words."""
        count = self.count[words]
        end = np.cumsum(count)
        if not len(end):
            return np.zeros(0, np.int32)
        return self.ids[np.arange(end[-1]) + np.repeat(self.start[words] - end + count, count)]

    def windows(self, batches, text_column: int = 1):
        """(batch, words of each of its rows) for Arrow batches; learn() has been called for all of them."""
        held, chars = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:  # a batch can be longer than a window
                rows = []
                for x in b.column(text_column)[at:]:
                    text = x.as_py() or ""
                    rows.append(self.words(text))
                    chars += len(text)
                    if chars > WINDOW_CHARS or len(self.index) - len(self.start) > WINDOW_WORDS:
                        break
                held.append((b.slice(at, len(rows)), rows))
                at += len(rows)
                if chars > WINDOW_CHARS or len(self.index) - len(self.start) > WINDOW_WORDS:
                    self.learn()
                    yield from held
                    held, chars = [], 0
                    if len(self.index) > REMEMBERED:
                        self.forget()
        self.learn()
        yield from held

    def decode(self, ids) -> bytes:
        tokens = self.v.tokens
        return b"".join([tokens[i] for i in ids])


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", pattern: str = PATTERN) -> DataFrame:
    """(id, ids array<int>) of every row of docs; a null or empty text has no ids."""

    @frugal
    def run(batches):
        e = Encoder(path, pattern)
        for b, rows in e.windows(batches):
            ids = [e.encode(w) for w in rows]
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.zeros(0, np.int32)]))], names=[id_col, "ids"])

    own = docs.select(id_col, "text")
    return own.mapInArrow(run, f"{id_col} {own.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, decoded binary) of every row of encoded (id, ids); null ids are none."""

    @frugal
    def run(batches):
        tokens = vocabulary(path).tokens
        for b in batches:
            out = [b"".join([tokens[i] for i in x.as_py() or ()]) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    own = encoded.select(id_col, "ids")
    return own.mapInArrow(run, f"{id_col} {own.schema[id_col].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", pattern: str = PATTERN) -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids joined by blanks), decoded_sha256 (of the bytes decoded from the ids)."""

    @frugal
    def run(batches):
        e = Encoder(path, pattern)
        text = [str(i) for i in range(len(e.v.tokens))]
        for b, rows in e.windows(batches):
            n, ids_sha, bytes_sha = [], [], []
            for w in rows:
                ids = e.encode(w).tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([text[i] for i in ids]).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(id_col, "text")
    kind = own.schema[id_col].dataType.simpleString()
    return own.mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
