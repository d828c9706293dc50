"""The stages of the pipeline against plain rules over lists of rows."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline as cp
from tamis.llm import decontaminate as dc
from tamis.llm import quality_rules as qr
from test_line_dedup import brute as brute_lines
from test_quality import brute_cuts, brute_scores, plain_base
from test_similar import brute as brute_similar

SF = "/root/testdata/sf0.001"


def read(name, folder=SF):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def good(rows, labels):
    trust = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = brute_scores(rows, {i for i, t in trust.items() if t and not held(i)})
    base = {i: plain_base(t) for i, t in rows}
    fine = {i: not (b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, b in base.items()}
    cut = brute_cuts({i: f for i, f in scores.items() if fine[i]}, trust, held)
    return [(i, t) for i, t in rows if fine[i] and all(x >= c for x, c in zip(scores[i], cut))]


def leaked(text, items):
    """Whether some item has leaked, by the rule on words alone: every block of the text is compared."""
    w = dc.words(text)
    for item in items:
        if not len(item):
            continue
        for k in range(0, len(w), dc.HALF):
            region = w[max(0, k - len(item)) : k + 2 * dc.HALF + len(item)]
            if np.isin(item, region).sum() < dc.PARAPHRASE * len(item):
                continue
            common = dc.common_subsequence(item.tolist(), region.tolist())
            answer = item[-dc.ANSWER :].tolist()
            if common >= dc.LEAK * len(item) or common >= dc.PARAPHRASE * len(item) and dc.common_subsequence(answer, region.tolist()) == len(answer):
                return True
    return False


def plain(docs, labels, benchmark):
    rows = good([(r["doc_id"], r["text"]) for r in docs], labels)
    after = [rows]
    rows = [(i, t) for i, _, _, t in brute_lines(rows, 10, "none")]
    after.append(rows)
    first, _ = brute_similar(rows)
    rows = [(i, t) for i, t in rows if first[i] == i]
    after.append(rows)
    items = [dc.words(r["text"]) for r in benchmark]
    after.append([(i, t) for i, t in rows if not leaked(t, items)])
    return after


def test_every_stage_equals_the_plain_rules(spark):
    want = plain(read("documents"), read("labels"), read("benchmark"))
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for (_, stage), rows in zip(cp.STAGES, want):
        docs = cp.table(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(sorted((r.doc_id, r.text) for r in docs.collect()))
        assert seen[-1] == sorted(rows)
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert len(seen[0]) > len(seen[2]) > len(seen[3]) > 50
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: library.encode_ordinary(t) for i, t in seen[3]}
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert got.keys() == ids.keys()
    for i, t in seen[3]:
        assert got[i].n_tokens == len(ids[i]) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def folder(tmp_path, docs, extra=()):
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), *extra]
    pq.write_table(pa.table({n: pa.array([r[k] for r in docs], t) for k, (n, t) in enumerate(kinds)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": [" ".join(f"leak{k}" for k in range(20)), None]}), tmp_path / "benchmark.parquet")
    return str(tmp_path)


def test_null_ids_repeated_ids_and_clashing_columns(spark, tmp_path):
    text = lambda tag, n=80: " ".join(f"{tag}{k}" for k in range(n))
    leak = text("own") + " " + " ".join(f"leak{k}" for k in range(20))
    names = ("r", "q", "kept", "row", "dropped", "n_lines", "n_dropped", "keep_bitmap", "key", "fp", "label", "node", "words", "h")
    rows = [
        (None, text("a")), (None, text("b")), (None, leak), (5, text("c")), (5, text("d")), (5, leak + " more"), (6, text("c") + " x"), (7, None), (8, ""), (9, text("e", 49)), (10, text("f")), (10, text("f")),
    ]
    sf = folder(tmp_path, [(*r, *names) for r in rows], [(n, pa.string()) for n in names])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = cp.table(stage(spark, docs, sf))
        assert docs.columns == columns
    left = docs.collect()
    want = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d")), (10, text("f"))]
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, want))
    assert all(r[n] == n for r in left for n in names)
    assert cp.run(spark, sf).count() == 5


def test_empty_tables(spark, tmp_path):
    assert cp.run(spark, folder(tmp_path, [])).count() == 0
