import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken

from helpers import DOCS
from tamis.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts, **new):
    e = bpe.Encoder(PATH)
    rows = [e.words(t) for t in texts]
    e.learn()
    return [e.encode(w).tolist() for w in rows]


def test_ids_equal_the_library(own):
    rng = random.Random(3)
    odd = "ab 'sTh\n\t \x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0​　éñß가😀٣²_-*'llre09.,́﻿\U000e0001"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice(w) for _ in range(rng.randrange(400))) for w in ("a", "ab", "aA", "=", " ", "\n", "th", "aaaab", "=-", "0") for _ in range(20)]
    texts += ["", "'", "'l", "'lx", "x" * 5000, "=" * 4097, " " * 3000, "ha" * 2000, "the " * 1000]
    assert ids_of(texts) == [own.encode_ordinary(t) for t in texts]


def test_ids_of_documents_equal_the_library(own):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert ids_of(texts) == [own.encode_ordinary(t) for t in texts]


def test_another_vocabulary_whose_merges_turn_back():
    # bc has a lower rank than ab and appears in no text; abb after ab is lower than cb
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 300, b"abb": 1, b"bb": 301, b"aa": 302, b"aaa": 2, b"ba": 303}
    own = tiktoken.Encoding("turn", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import os
    import tempfile

    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken", delete=False) as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    rng = random.Random(5)
    texts = ["".join(rng.choice("abb") for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    e = bpe.Encoder(f.name)
    rows = [e.words(t) for t in texts]
    e.learn()
    assert [e.encode(w).tolist() for w in rows] == [own.encode_ordinary(t) for t in texts]
    os.unlink(f.name)


def test_query_round_trip_and_edge_cases(spark, own, monkeypatch):
    rows = [(1, None), (2, ""), (3, "One two\n two 'll"), (3, "One two\n two 'll"), (None, "\U0001f600 x"), (4, "wörd " * 9000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", ids int")
    got = bpe.round_trip(docs, PATH).collect()
    want = [(i, t or "") for i, t in rows]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((i, len(x := own.encode_ordinary(t)), sha(" ".join(map(str, x))), sha(t)) for i, t in want), key=key)
    encoded = bpe.encode_texts(docs, PATH)
    assert sorted((r.doc_id or -1, bytes(r.decoded).decode()) for r in bpe.decode_ids(encoded, PATH).collect()) == sorted((i or -1, t) for i, t in want)
    assert bpe.round_trip(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_small_windows_change_nothing(own, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "WINDOW_CHARS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = [f"some words {i} and {'more ' * (i % 7)}" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    e = bpe.Encoder(PATH)
    got = [e.encode(w).tolist() for b, rows in e.windows([batch]) for w in rows]
    assert got == [own.encode_ordinary(t) for t in texts]
