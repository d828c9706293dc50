import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from helpers import DOCS
from tamis.llm import lm_score as lm

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute(rows):
    low = str.maketrans(UPPER, UPPER.lower())
    toks = [(i, (t or "").translate(low).encode().split() + [None]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in toks if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks]


def check(got, rows):
    key = lambda r: (r[0] or -1, r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and abs(g.base_score - w[5]) < 1e-6 * max(1, abs(w[5]))


def test_whole_table_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_corpus(docs).collect()
    check(got, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_counts_beyond_the_broadcast_list_are_exact(spark):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(9)) + " The the") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    counts = lm.token_counts(docs.where(~lm.held_out(docs["doc_id"]))).cache()
    v = lm.vocabulary(counts, known=5)
    check(lm.score(docs, v, lm.Model.unigram(v.shape, v.mass), counts).collect(), rows)


def test_probabilities_sum_to_one(spark):
    """Over all leaves, whatever came before; and a leaf's mass is that of its words and one unseen word."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 60).clip(0, 3000))) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    counts = lm.token_counts(docs).cache()
    v = lm.vocabulary(counts)
    model = lm.train(docs, v)
    n, own = v.shape.leaves, v.shape.own
    assert np.abs(model.weights).max() > 0
    for before in ([5, 9, 40], [own + 3], []):
        k = len(before) + 1
        leaf = np.c_[np.tile(np.array(before, np.int32), (n, 1)), np.arange(n, dtype=np.int32)]
        word = np.c_[np.tile(np.array(before, np.uint32) + 77, (n, 1)), np.full(n, 5, np.uint32)]
        each = model.log_prob(word.ravel(), leaf.ravel().astype(np.int32), np.arange(n + 1) * k).reshape(n, k)[:, -1]
        assert abs(np.exp(each).sum() - 1) < 1e-4
    by_leaf = Counter()
    for r in counts.collect():
        if r.word is not None:
            by_leaf[v.leaf(bytes(r.word))] += r.c + 1
    assert all(v.mass[leaf] == m + (leaf >= own) for leaf, m in by_leaf.items())


def test_the_model_grows_with_the_corpus_and_does_not_depend_on_the_cluster(spark):
    small, large = lm.Shape.of(10**7, 10**6), lm.Shape.of(10**10, 10**8)
    assert large.leaves > 8 * small.leaves and large.rows >= 8 * small.rows and large.shards > 8 * small.shards
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    v = lm.vocabulary(lm.token_counts(docs))
    one, other = lm.train(docs.repartition(1), v), lm.train(docs.repartition(7), v)
    assert np.allclose(one.weights, other.weights, atol=1e-6)


def test_sparse_gradients_equal_dense_ones():
    """One AdaGrad step of all levels against plain loops."""
    shape = lm.Shape(4, 256, 2)
    rng = np.random.default_rng(3)
    model = lm.Model.unigram(shape, rng.uniform(1, 9, shape.leaves))
    model.weights[:] = rng.normal(0, 0.3, model.weights.shape)
    plain, squares = model.weights.copy().astype(float), np.ones(shape.rows)
    leaf, word, first = rng.integers(0, 64, 300).astype(np.int32), rng.integers(0, 40, 300).astype(np.uint32), np.array([0, 100, 300])
    found = lm.features(word, leaf, first, shape)
    for level, node, branch in model.steps(leaf):
        sums = np.zeros_like(plain)
        for t in range(300):
            z = model.bias[level][node[t]] + sum(plain[r] for r in found[level][:, t])
            g = np.exp(z - z.max())
            g /= g.sum()
            g[branch[t]] -= 1
            for r in found[level][:, t]:
                sums[r] += g
        squares += (sums**2).sum(1) / 4
        plain -= lm.RATE * sums / np.sqrt(squares)[:, None]
    own, met = np.ones(shape.rows, np.float32), np.zeros(shape.rows, np.int64)
    lm.train_on(model, word, leaf, first, own, met)
    assert np.allclose(model.weights, plain, atol=1e-4) and met.sum() == 3000


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A b"), (3, "A b"), (None, "a c"), (7, "x " * 50_000)]
    check(lm.score_corpus(spark.createDataFrame([(*r, 1.0) for r in rows], DOCS + ", score double")).collect(), rows)
    assert lm.score_corpus(spark.createDataFrame([], DOCS)).count() == 0
    alone = [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "never trained")]
    check(lm.score_corpus(spark.createDataFrame(alone, DOCS)).collect(), alone)


def test_each_distinct_word_is_looked_up_once():
    """op8's time: a batch's words are looked up once each, not once per token; numbers equal a plain split's."""
    texts = ["  Ab\x85 \tC  ", "", " ", "x", None, "É é\x0b\x0cq\x1c\r\n", "\n", "ab c ab c " * 500, "c\xa0d"]
    shape = lm.Shape(8, 1024, 2)
    words = [None, b"c", b"x"]
    known = lm.Vocabulary(9, 9, shape, words, np.array([9, 5, 2]), np.array([5, 40, 41], np.int32), np.ones(shape.leaves))
    reader, looked = lm.Reader(known), Counter()

    class Counted(type(reader.number)):
        def __getitem__(self, word):
            looked[word] += 1
            return super().__getitem__(word)

    factory = (reader.number.default_factory,) if hasattr(reader.number, "default_factory") else ()
    reader.number = Counted(*factory, reader.number)
    for _ in range(2):
        looked.clear()
        numbers, first = reader.tokens(pa.array(texts))
        assert max(n for w, n in looked.items() if w is not None) == 1
        low = str.maketrans(UPPER, UPPER.lower())
        plain = [(t or "").translate(low).encode().split() + [None] for t in texts]
        assert first.tolist() == [0, *np.cumsum([len(p) for p in plain])]
        name = list(reader.number)
        assert [name[i] for i in numbers] == [w for p in plain for w in p]
        for w, i in zip((w for p in plain for w in p), numbers):
            rank = words.index(w) if w in words else -1
            assert (reader.rank[i], reader.leaf[i], reader.hash[i]) == (rank, known.leaf(w), 1 if w is None else zlib.crc32(w))
