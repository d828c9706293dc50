import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from helpers import DOCS
from tamis.llm import range_coder, token_file

PATH = P.path("byte_bpe_50k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, n).clip(0, 65535).astype(np.uint32) for n in (0, 1, 2, 300, 5000, 77)]
    blocks += [np.tile(np.arange(40), 50).astype(np.uint32), rng.integers(0, 65536, 3000).astype(np.uint32), np.full(3000, 65535, np.uint32), np.zeros(9000, np.uint32)]
    coded = range_coder.compress(blocks)
    for a, b in zip(blocks, range_coder.expand(coded, [len(b) for b in blocks])):
        assert np.array_equal(a, b)
    assert len(coded[-1]) < 400 and len(coded[6]) < 1200
    big = [rng.integers(0, 1 << 20, 500).astype(np.uint32)]
    assert np.array_equal(range_coder.expand(range_coder.compress(big, 5), [500], 5)[0], big[0])
    # each block decodes alone
    assert np.array_equal(range_coder.expand(coded[4:5], [5000])[0], blocks[4])


def test_a_damaged_block_is_found():
    ids = [np.arange(500, dtype=np.uint32)]
    data = token_file.pack(ids, range_coder.compress(ids), 4)
    nibbles, ((n, crc, coded),) = token_file.unpack(data)
    assert (nibbles, n) == (4, 500) and zlib.crc32(ids[0].tobytes()) == crc
    with pytest.raises(ValueError):
        token_file.unpack(data[:-1])
    with pytest.raises(ValueError):
        token_file.unpack(b"XXXX" + data[4:])


def plain(rows, end=0):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT", 3000)
    path = "/root/testdata/sf0.001/documents.parquet"
    t = pq.read_table(path, columns=["doc_id", "text"]).to_pydict()
    got = token_file.round_trip(spark.read.parquet(path), PATH).orderBy("start").collect()
    assert [tuple(r) for r in got] == plain(sorted(zip(t["doc_id"], t["text"])))


def test_edge_cases(spark, tmp_path):
    rows = [(2, None), (1, ""), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (7, "wörd " * 20000), (5, "x")]
    special = Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert 50256 in special and len(special) == 4
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", ids int")
    got = token_file.round_trip(docs, PATH).orderBy("start").collect()
    assert [tuple(r) for r in got] == plain(sorted(rows, key=lambda r: r[0]))
    path = str(tmp_path / "ids")
    token_file.write_ids(docs, PATH, path, end_id=9)
    ids = {r.doc_id: r.ids for r in token_file.read_ids(spark, path).collect()}
    assert ids[2] == [9] and len(ids[7]) > 20000
    assert token_file.round_trip(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_coding_both_ways_takes_less_time_than_the_library():
    """op2's time: ids of real texts, each way against the library that made them; and the frequencies that blocks share pay."""
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    library = token_file.Tokenizer(PATH)
    clock = time.process_time
    began = clock()
    ids = np.concatenate(library.encode(texts))[: 256 * 4096]
    encoding = (clock() - began) * len(ids) / sum(map(len, library.encode(texts)))
    blocks, shared = [ids[k : k + 4096] for k in range(0, len(ids), 4096)], range_coder.frequencies(ids)
    began = clock()
    coded = range_coder.compress(blocks, 4, [shared] * len(blocks))
    writing, began = clock() - began, clock()
    back = range_coder.expand(coded, [len(b) for b in blocks], 4, [shared] * len(blocks))
    reading = clock() - began
    assert np.array_equal(np.concatenate(back), ids)
    assert sum(map(len, coded)) + len(shared) < sum(map(len, range_coder.compress(blocks)))
    assert writing + reading < 3 * encoding


def test_an_id_beyond_the_nibbles_is_an_error():
    ids = np.array([5, 1 << 16], np.uint32)
    with pytest.raises(ValueError):
        range_coder.compress([ids], 4, [range_coder.frequencies(ids)])
    wide = np.arange(1 << 18, dtype=np.uint32)[::-1] * 3
    blocks = [wide[k : k + 4096] for k in range(0, len(wide), 4096)]
    shared = [range_coder.frequencies(wide)] * len(blocks)
    assert np.array_equal(np.concatenate(range_coder.expand(range_coder.compress(blocks, 5, shared), [4096] * 64, 5, shared)), wide)


def test_every_choice_has_a_share():
    """However sure the orders are: a choice without a share could be written, but not read."""
    mixed = np.array(np.meshgrid([1, 2, 3, 4, 2048, 4092, 4093, 4094, 4095], [1, 2, 3, 4, 2048, 4092, 4093, 4094, 4095]), np.int32).reshape(2, -1)
    for asked in ((0, 0), (0, 1), (1, 0), (1, 1)):
        valid = np.repeat(np.array(asked, bool)[:, None], mixed.shape[1], 1)
        a, b = range_coder._bounds(mixed, valid)
        assert np.array_equal(a > 0, valid[0]) and np.array_equal(b > a, valid[1]) and (b < 65536).all()
    # long runs that break off
    rng = np.random.default_rng(1)
    blocks = []
    for _ in range(200):
        parts = [x for _ in range(12) for x in (np.full(rng.integers(100, 400), 7), rng.choice([5, 7, 9, 50000], rng.integers(1, 30)), np.array([5, 9, 7]))]
        blocks.append(np.concatenate(parts).astype(np.uint32))
    shared = [range_coder.frequencies(np.concatenate(blocks))] * len(blocks)
    back = range_coder.expand(range_coder.compress(blocks, 4, shared), [len(b) for b in blocks], 4, shared)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
