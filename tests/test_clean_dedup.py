import numpy as np
import pytest

from tamis.operators import clean, dedup, embed, quality

DOCS = "doc_id long, text string"
BODY = "The archive keeps every record for ninety days and then deletes it."


def reasons(df):
    return {r.doc_id: r.reason for r in df.collect()}


def clusters(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, cluster_id long")


def test_conservative_keeps_the_first_of_equal_forms(spark):
    docs = spark.createDataFrame([(3, "a  b"), (1, "a b"), (2, " a\nb "), (4, "A b"), (5, None), (6, "")], DOCS)
    assert reasons(clean.decide(docs, "conservative")) == {1: None, 2: "exact_duplicate", 3: "exact_duplicate", 4: None, 5: None, 6: "exact_duplicate"}


def test_survivor_of_a_cluster(spark):
    docs = spark.createDataFrame([(1, BODY.replace(" keeps", "  keeps").replace(".", " .")), (2, BODY + " Really so."), (3, BODY), (4, "ok")], DOCS)
    found = clusters(spark, [(1, 0), (2, 0), (3, 0)])
    assert reasons(clean.decide(docs, "moderate", found)) == {1: "duplicate", 2: "duplicate", 3: None, 4: "too_short"}
    assert reasons(clean.deduplicate_only(docs, found, "longest")) == {1: "duplicate", 2: None, 3: "duplicate", 4: None}
    assert reasons(clean.deduplicate_only(docs, found)) == {1: None, 2: "duplicate", 3: "duplicate", 4: None}


def test_aggressive_reasons_and_counts(spark):
    docs = spark.createDataFrame([(1, BODY), (2, "@#$%^&*()@#$%^&*() @#$% @#$%"), (3, "no"), (4, "internationalisation")], DOCS)
    d = clean.decide(docs, "aggressive")
    assert reasons(d) == {1: None, 2: "high_special_char_ratio", 3: "too_short", 4: "low_word_count"}
    assert clean.kept(docs, d).count() + clean.removed(docs, d).count() == docs.count()
    assert {r.reason: r.n for r in clean.summary(d).collect()} == {"kept": 1, "high_special_char_ratio": 1, "too_short": 1, "low_word_count": 1}
    with pytest.raises(ValueError):
        clean.decide(docs, "brutal")


def test_filters(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "x" * 60)], DOCS)
    assert reasons(clean.filter_by_length(docs, 0, 0)) == {1: None, 2: None}
    assert reasons(clean.filter_by_length(docs, 5, 50)) == {1: "too_short", 2: "too_long"}
    stats = quality.doc_stats(docs).where("doc_id = 1")
    assert reasons(clean.filter_by_quality_score(docs, stats)) == {1: "low_quality", 2: None}


def test_clusters_are_transitive_and_numbered(spark):
    vectors = spark.createDataFrame([(9, [1.0, 0.0, 0.0]), (5, [0.95, 0.31, 0.0]), (7, [0.8, 0.6, 0.0]), (1, [0.0, 0.0, 1.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0])], "doc_id long, embedding array<float>")
    for block in (2048, 2):
        pairs = dedup.cosine_pairs(vectors, 0.92, block=block)
        assert {(r.a, r.b) for r in pairs.collect()} == {(5, 9), (5, 7), (1, 2)}
    found = dedup.clusters(pairs)
    assert {(r.doc_id, r.cluster_id) for r in found.collect()} == {(1, 0), (2, 0), (5, 1), (7, 1), (9, 1)}
    stats = {r.cluster_id: (r.size, r.representative_id) for r in dedup.cluster_stats(found, pairs).collect()}
    assert stats == {0: (2, 1), 1: (3, 5)}
    total = dedup.duplicate_totals(found, 6).first()
    assert (total.total_duplicates, total.unique_duplicates) == (5, 3) and abs(total.duplicate_percentage - 500 / 6) < 1e-9


def test_long_chains_settle(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.cluster_id for r in dedup.clusters(pairs).collect()} == {0}


def test_minhash_finds_near_copies(spark):
    docs = spark.createDataFrame([(0, BODY), (1, BODY.replace("ninety", "eighty")), (2, "Something else entirely, about the weather in the hills."), (3, BODY), (4, "")], DOCS)
    assert (0, 1) in {(r.a, r.b) for r in dedup.minhash_candidates(docs).collect()}
    assert {(r.a, r.b) for r in dedup.jaccard_pairs(docs, 0.7).collect()} == {(0, 1)}
    pairs = dedup.two_stage_pairs(docs, embed.provider("hashed").embed(docs), 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1)}
    own = dedup.document_clusters(docs, pairs)
    assert {r.doc_id for r in own.collect()} == {0, 1, 3}
    noise = {r.doc_id: r.degree for r in dedup.noise_scores(docs, pairs).collect()}
    assert noise == {0: 2, 1: 2, 3: 2, 2: 0, 4: 0}
    assert dedup.bands_for(0.5, 128) == (25, 5)


def test_shingles():
    n = lambda t: len(dedup.shingle_hashes(t, 4))
    assert [n(x) for x in ("ABcd  e", "ab", "", None, "aaaaaaaa", "가나다라마", "a" * 100_000)] == [3, 1, 0, 0, 1, 2, 1]
    assert set(dedup.shingle_hashes("abcd", 4)) < set(dedup.shingle_hashes("xABCD", 4)) and dedup.shingle_hashes("ab", 4)[0] != dedup.shingle_hashes("ba", 4)[0]


def test_providers():
    p = embed.HashedNgrams(64)
    assert np.linalg.norm(p.vector("")) == 0 and abs(np.linalg.norm(p.vector("some text")) - 1) < 1e-9 and abs(np.linalg.norm(p.vector("ab")) - 1) < 1e-9
    assert embed.SentenceModel().duplicate_threshold == 0.985
    with pytest.raises(ValueError):
        embed.provider("none")


def test_jaccard_equals_brute_force_in_groups_and_out_of_them(spark, monkeypatch):
    import random

    rng, docs = random.Random(5), []
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    for size, copies in ((150, 24), (60, 10), (12, 6), (1, 5), (400, 3)):
        base = rng.choices(words, k=size)
        for _ in range(copies):
            docs.append(" ".join(rng.choice(words) if rng.random() < 0.04 else w for w in base))
    docs += [" ".join(rng.choices(words, k=rng.randrange(0, 90))) for _ in range(40)] + [docs[0], docs[0], None, "", "x"]
    rng.shuffle(docs)
    frame, tables, real = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df: tables.append(real(df)) or tables[-1])
    monkeypatch.setattr(dedup, "FEW", 4)
    monkeypatch.setattr(dedup, "BLOCK", 8)

    own = {}
    for i, t in enumerate(docs):
        own.setdefault(t or "", []).append(i)
    sets = {o[0]: set(dedup.shingle_hashes(t, 4).tolist()) for t, o in own.items()}
    copies = {o[0]: len(o) for o in own.values()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    want = {p: x for p, x in want.items() if x >= 0.7}
    assert len(want) > 100
    rows = dedup.jaccard_pairs(frame, 0.7).collect()
    assert {(r.a, r.b): r.score for r in rows} == want and len(rows) == len(want)
    assert not any("shingles" in t.columns for t in tables)  # before, all shingles were written, and shuffled for each candidate

    linked = {}
    for a, b in want:
        linked[a], linked[b] = linked.get(a, 0) + copies[b], linked.get(b, 0) + copies[a]
    assert {r.rep: r.linked for r in dedup.jaccard_degrees(frame, 0.7).collect()} == linked

    def parts(pairs):
        root = {i: i for i in sets}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for i in sets}

    links = [(r.a, r.b) for r in dedup.jaccard_links(frame, 0.7).collect()]
    assert parts(links) == parts(want) and set(links) <= set(want)


def test_least_hashes_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for n, more in ((6, 1), (40, 10), (3000, 750)):
        agree = []
        for _ in range(30):
            h = rng.integers(0, 1 << 63, n + 2 * more, dtype=np.uint64)
            agree.append((dedup._least_hashes(h[:-more], 1280) == dedup._least_hashes(h[more:], 1280)).mean())
        assert abs(np.mean(agree) - n / (n + 2 * more)) < 0.05
    assert (1 - 0.8**13) ** dedup.least_bands(0.8, 13) <= dedup.MISSED


def test_marks_never_rule_out_a_similar_pair(spark):
    rng = np.random.default_rng(2)
    texts = {i: "".join(rng.choice(list("abcdefgh "), 40 + 37 * (i // 2))) for i in range(60)}
    for i in range(1, 60, 2):
        texts[i] = texts[i - 1][: -(len(texts[i - 1]) // 12)]
    marks = dedup._parity(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4)
    a, b = (marks.selectExpr(f"doc_id AS {i}", f"mark AS _{i}", f"size AS _n{i}") for i in "ab")
    sets = {i: set(dedup.shingle_hashes(t, 4).tolist()) for i, t in texts.items()}
    left = {(r.a, r.b) for r in dedup._may_be_similar(a.join(b, on=a.a < b.b).select("a", "b", "_a", "_b", "_na", "_nb"), 0.8, "long").collect()}
    right = {(x, y) for x in texts for y in texts if x < y and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8}
    assert len(right) > 25 and right <= left and len(left) < 600
