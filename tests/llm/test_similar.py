import re

import numpy as np

from helpers import DOCS
from tamis.llm import similar


def plain_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, least=0.8):
    """doc_id -> smallest doc_id of its component, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9):
                pairs += sets[a] != sets[b]
                root[find(a)] = find(b)
    comp = {}
    for k, (i, _) in enumerate(rows):
        comp[find(k)] = min(i, comp.get(find(k), i))
    return {i: comp[find(k)] for k, (i, _) in enumerate(rows)}, pairs


def edited(rng, words, share):
    out = list(words)
    for k in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        out[k] = f"new{rng.integers(1 << 30)}"
    return out


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for k in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(6, 300))]
        for _ in range(rng.integers(1, 9)):
            rows.append((n, " ".join(edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04, 0.08])))))
            n += 1
    rows += [(n, rows[3][1].upper()), (n + 1, None), (n + 2, "  "), (n + 3, "a b"), (n + 4, "A  b")]
    want, pairs = brute(rows)
    got = {r.key.doc_id: r.component.doc_id for r in similar.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert pairs > 60
    missed = [i for i in want if got[i] != want[i]]
    assert not missed
    cut = {r.key.doc_id: r.component.doc_id for r in similar.classes(spark.createDataFrame(rows, DOCS), split=5, piece=3000).collect()}
    assert cut == want


def test_links_of_sets_match_the_plain_rule():
    rng = np.random.default_rng(5)
    base = np.arange(200)
    sets = [base] + [np.unique(np.r_[np.delete(base, (i * 5) % 200), 1000 + i, 5000 + i]) for i in range(1, 60)]
    sets += [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(60)] + [np.zeros(0, np.int64)] * 2
    for least in (0.5, 0.8, 0.98):
        i, j = similar.similar_sets(sets, least)
        root = list(range(len(sets)))
        want = list(range(len(sets)))
        for parts, pairs in ((root, zip(i.tolist(), j.tolist())), (want, ((a, b) for a in range(len(sets)) for b in range(a) if len(set(sets[a]) & set(sets[b])) >= least * len(set(sets[a]) | set(sets[b])) - 1e-9))):
            for a, b in pairs:
                x, y = sorted((parts[a], parts[b]))
                parts[:] = [x if k == y else k for k in parts]
        assert root == want


def test_texts_that_are_alike_to_one_text_only(spark):
    base = [f"w{x}" for x in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        own = list(base)
        at = (i * 5) % 200
        own[at] = own[(at + 100) % 200] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r.key.doc_id: r.component.doc_id for r in similar.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute(rows)[0]


def test_keep_one(spark):
    base = " ".join(f"w{x}" for x in range(100))
    near = base.replace("w50", "other")
    rows = [(4, base), (2, near), (None, base), (None, "quite another text without an id"), (None, None), (7, ""), (8, base), (8, base), (9, "different words for the same id"), (9, near)]
    kept = similar.keep_one(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", key string"))
    assert kept.columns == ["doc_id", "text", "key"]
    want = [(2, near), (None, "quite another text without an id"), (7, ""), (9, "different words for the same id")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    assert similar.keep_one(spark.createDataFrame([], DOCS)).count() == 0
