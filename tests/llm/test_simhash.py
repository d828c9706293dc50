import re

import numpy as np
import pyarrow.parquet as pq
import xxhash

from helpers import DOCS, brute_components
from tamis.llm import simhash


def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_fingerprint_matches_the_plain_rule():
    for t in (None, "", " \n\t ", "a", "A b", "a B c d", "a b c d e", "Éa x\x0by Z q é", "w " * 5000, "x\u00a0y z a b c"):
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_bit_sliced_links_match_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:20]:
        for _ in range(12):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(k)
            fps.append(x)
    fps = np.array(sorted(set(fps)), np.uint64)
    for radius in (0, 1, 3, 4, 7):
        u, v = simhash.link_sorted(fps, np.zeros(len(fps), np.int64), radius)
        want = brute_components(range(len(fps)), [int(x) for x in fps], radius)
        root = {int(x): int(x) for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u, v):
            assert int(a ^ b).bit_count() <= 64
            root[find(int(a))] = find(int(b))
        groups = [find(int(x)) for x in fps]
        assert len(set(zip(groups, want))) == len(set(groups)) == len(set(want))


def test_groups_do_not_mix():
    fps = np.array([1, 3, 1, 3], np.uint64)
    u, v = simhash.link_sorted(fps, np.array([0, 0, 1, 1]), 4)
    assert list(zip(u.tolist(), v.tolist())) == [(3, 1), (3, 1)]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A B C D E F"), (None, "p q"), (7, "long " * 30000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[(1, "0" * 16)] == by[(2, "0" * 16)] == 1
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = simhash.keep_one(spark.createDataFrame([(*r, 5) for r in rows], DOCS + ", fp int"))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 7]


def test_whole_table_matches_brute_force_in_every_scheme(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    t = pq.read_table(path, columns=["doc_id", "text"]).to_pydict()
    fps = [plain_fingerprint(x) for x in t["text"]]
    want = dict(zip(t["doc_id"], brute_components(t["doc_id"], fps, 4)))
    docs = spark.read.parquet(path)
    for choose in (None, 3):
        got = simhash.near_duplicates(docs, choose=choose).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in zip(t["doc_id"], fps)}


def test_split_buckets_give_the_same_links(spark):
    from tamis.llm.components import components

    fps = [i for i in range(60)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    whole = {r.node: r.root for r in components(simhash.edges(df, 1)).collect()}
    cut = {r.node: r.root for r in components(simhash.edges(df, 1, split=7)).collect()}
    assert whole == cut == {x: 0 for x in fps}


def test_keep_one_keeps_a_row_of_each_component(spark):
    a, b, c = ("clear water runs down the old hill", "nine ships left port at dawn today", "a red fox sleeps under our barn")
    rows = [(None, a), (None, b), (None, b), (None, c), (5, c), (6, c), (7, a + " x"), (7, "quite another text of the same id"), (7, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS), radius=0).collect()
    want = [(None, a), (None, b), (5, c), (7, a + " x"), (7, "quite another text of the same id"), (7, None)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
