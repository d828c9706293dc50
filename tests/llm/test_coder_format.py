import hashlib
import struct
import zlib

import numpy as np

from tamis.llm import range_coder as rc


def blocks(n=40, size=700):
    k = np.arange(n * size, dtype=np.int64)
    ids = np.where(k % 7 < 4, k % 7 * 31 + k // 900, (k * k // 3 + 17 * k) % 40_009).astype(np.uint32)
    return [ids[i : i + size - i // size % 5] for i in range(0, len(ids), size)]


def test_a_block_is_coded_to_the_same_bytes_as_ever():
    """Files that are written stay readable: the digests are of what the coder wrote before its steps were made in place."""
    own = blocks()
    shared = [rc.frequencies(np.concatenate(own))] * len(own)
    assert hashlib.sha256(shared[0]).hexdigest()[:16] == "8765c645302fc059"
    coded = rc.compress(own, 4, shared)
    assert hashlib.sha256(b"".join(coded)).hexdigest()[:16] == "432933ac91dc392e"
    assert all(np.array_equal(a, b) for a, b in zip(own, rc.expand(coded, [len(b) for b in own], 4, shared)))


def test_frequencies_match_the_plain_rule_and_are_counted_without_a_sort(monkeypatch):
    k = np.arange(1 << 18, dtype=np.uint64)
    for ids in (k * k % 40_009, k * k % 40_009 * 100_003, k[:1], k[:0]):
        ids = ids.astype(np.uint32)
        found, n = np.unique(ids, return_counts=True)
        bits, many = struct.unpack_from("<BI", data := rc.frequencies(ids))
        both = np.frombuffer(zlib.decompress(data[5:]), "<u4")
        assert many == len(found) and np.array_equal(np.cumsum(both[:many], dtype=np.int64), found)
        assert np.array_equal(both[many:], 1 + n * ((1 << bits) - many) // max(len(ids), 1))
    monkeypatch.setattr(np, "unique", None)
    assert len(rc.frequencies((k * k % 997).astype(np.uint32)))
