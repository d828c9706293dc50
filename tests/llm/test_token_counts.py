import random

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from helpers import DOCS
from tamis.llm import bpe, token_counts as tc

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def count():
    return tc.Pieces(bpe.vocabulary(PATH))


def total(text):
    e = bpe.Encoder(PATH)
    w = e.words(text)
    e.learn()
    return int(e.count[w].sum())


def test_random_edits_equal_counting_anew(count, monkeypatch):
    monkeypatch.setattr(tc, "LEAF", 4)
    rng = random.Random(2)
    bits = ["the", " ", "  ", "\n", "\n\n", "'", "'s", "'ll", "l", "9", "42", "...", "-", "é", "　", "word", " x", "\t"]
    for turn in range(120):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 80)))
        tree = tc.TokenTree(text, count)
        for _ in range(12):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 30]))
            put = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 40])))
            text = text[:a] + put + text[b:]
            tree.edit(a, b, put)
            assert tree.text() == text
            assert [n for x in tree.lengths for n in x] == [len(p) for p in tree_pieces(text)]
            assert tree.total == sum(map(count, tree_pieces(text)))


def tree_pieces(text):
    import regex

    return regex.findall(bpe.PATTERN, text)


def test_small_pieces_equal_the_replay(count):
    for piece in ("zzzzqqq", " unbelievable", "éééé", "=" * 79, "=" * 200, "ab" * 39):
        assert count(piece) == total(piece)


def test_only_a_neighbourhood_is_split_again(count):
    text = "some plain words and more of them. " * 3000
    tree = tc.TokenTree(text, count)
    tree.edit(50_000, 50_004, "XYZ")
    assert tree.rescanned < 60 and tree.total == total(tree.text())
    with pytest.raises(ValueError):
        tree.edit(5, 10**9, "")


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    t = pq.read_table(path, columns=["doc_id", "text"]).to_pydict()
    got = {r.doc_id: r for r in tc.count_edited(spark.read.parquet(path), PATH).collect()}
    assert sum(r.n_edits for r in got.values()) > 0
    for i, text in zip(t["doc_id"], t["text"]):
        edits = tc.cleaning_edits(text or "")
        assert (got[i].n_tokens, got[i].n_edits, got[i].n_tokens_edited) == (total(text or ""), len(edits), total(tc.apply_edits(text or "", edits)))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a\na\na"), (3, "a\na\na"), (None, "me@x.org 1234567"), (4, "a" * 300_000)]
    got = tc.count_edited(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_tokens int"), PATH).collect()
    assert sorted((r.doc_id or -1, r.n_edits, r.n_tokens_edited) for r in got) == [(-1, 2, total("[email] 0")), (1, 0, 0), (2, 0, 0), (3, 2, 1), (3, 2, 1), (4, 0, total("a" * 300_000))]
    assert tc.count_edited(spark.createDataFrame([], DOCS), PATH).count() == 0
