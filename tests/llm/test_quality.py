import re

import numpy as np
import pyarrow as pa

from helpers import DOCS
from tamis.llm import grams, quality_classifier as qc, quality_rules as qr
from tamis.llm.common import trusted_labels

SF = "/root/testdata/sf0.01"


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {w: windows.count(w) for w in set(windows)}
    on = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(on)


def test_base_counts():
    for t in (None, "", " \n ", "a b c", "a b c a b c", "é é é é\nx\nx\n\n\n x\nx", "a a a a a", "q|w <e> #*$%&\x0b\x0cz\xa0z", "a b c d\x1fe a b c"):
        assert qr.base_counts(t) == plain_base(t), t
    rng = np.random.default_rng(0)
    for n in (5, 20, 90):
        t = " ".join(rng.choice(list("abcde"), n))
        assert qr.base_counts(t) == plain_base(t)


def test_hashed_grams_follow_the_rows():
    texts = ["abcdefg", None, "", "abcd", "abcde", "éabcde"]
    buckets, first = grams.hashed(pa.array(texts))
    assert np.diff(first).tolist() == [3, 0, 0, 0, 1, 3]
    assert buckets[0] == buckets[3] == buckets[-1]
    sums = grams.row_sums(np.ones(len(buckets)), first)
    assert sums.tolist() == [3, 0, 0, 0, 1, 3]


def brute_scores(docs, fits):
    out = {i: [] for i, _ in docs}
    for width, bits in qr.FAMILIES:
        raw, target, each = np.zeros(1 << bits), np.zeros(1 << bits), {}
        for i, t in docs:
            each[i], _ = grams.hashed(pa.array([t]), width, bits)
            np.add.at(raw, each[i], 1)
            if i in fits:
                np.add.at(target, each[i], 1)
        ratio = np.log((target + qr.PSEUDO) / (raw * (target.sum() / raw.sum()) + qr.PSEUDO))
        for i, b in each.items():
            out[i] += [ratio[b].mean() if len(b) else 0.0, np.minimum(ratio[b] + qr.EVIDENCE, 0).mean() if len(b) else 0.0]
    return {i: (a, b, d) for i, (a, b, _, d) in out.items()}


def brute_cuts(figures, trust, held):
    """The cuts by plain loops over the grid's steps that occur."""
    found = []
    for k, price in enumerate((qr.CARE, qr.CARE, qr.RARE_CARE)):
        rows = [(int(min(qr.GRID - 1, max(0, np.floor((f[k] + 4) * (qr.GRID / 5))))), trust[i]) for i, f in figures.items() if i in trust and (not trust[i] or held(i))]
        if k == 2:
            rows = [r for r, (i, f) in zip(rows, [x for x in figures.items() if x[0] in trust and (not trust[x[0]] or held(x[0]))]) if f[0] >= found[0] and f[1] >= found[1]]
        clean, bad = sum(t for _, t in rows), sum(not t for _, t in rows)
        best = (0.0, float("-inf"))
        for s in sorted({s for s, _ in rows}) if clean and bad else []:
            gain = sum(not t for x, t in rows if x <= s) / bad - price * (sum(t for x, t in rows if x <= s) + 1) / (clean + 1)
            if gain > best[0] + 1e-12:
                best = (gain, (s + 1) * 5 / qr.GRID - 4)
        found.append(best[1])
    return found


def test_quality_rules_on_the_whole_table(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = trusted_labels(spark, SF)
    got = {r.doc_id: r for r in qr.judge(docs, labels).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    trust = {r.doc_id: r.trusted for r in labels.collect()}
    want = brute_scores(rows, {i for i, t in trust.items() if t and zlib.crc32(str(i).encode()) % 5})
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == qr.base_counts(t)
        assert abs(r.llr - want[i][0]) < 1e-5 and abs(r.damning - want[i][1]) < 1e-5 and abs(r.rare - want[i][2]) < 1e-5
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    figures = {i: (r.llr, r.damning, r.rare) for i, r in got.items() if not r.base_failed}
    cut = brute_cuts(figures, trust, lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i].kept == all(x >= c for x, c in zip(f, cut)) for i, f in figures.items())
    judged = [(trust[i], got[i].kept) for i in trust if i in got and not got[i].base_failed]
    clean, bad = [k for t, k in judged if t], [k for t, k in judged if not t]
    assert np.mean(clean) > 0.97 and np.mean(bad) < 0.5
    kept = qr.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}


def test_quality_rules_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 60), (3, "word " * 60), (None, "alpha beta " * 3), (4, " ".join(f"w{i}" for i in range(60)))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", kept int")
    none = spark.createDataFrame([], "doc_id long, trusted boolean")
    got = sorted(((r.doc_id or -1), r.base_failed, r.kept) for r in qr.judge(docs, none).collect())
    assert got == [(-1, True, False), (1, True, False), (2, True, False), (3, True, False), (3, True, False), (4, False, True)]
    assert qr.judge(spark.createDataFrame([], DOCS), none).count() == 0
    odd = spark.createDataFrame([(None, True), (1, None), (4, True), (4, True)], "doc_id long, trusted boolean")
    assert qr.judge(docs, odd).count() == len(rows)


def test_classifier_orders_unseen_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ratings = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality + 1 - toxic AS grade")
    model = qc.fit(docs, ratings.where("doc_id % 2 = 0"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1] and model.lowest == 0
    got = qc.score(docs, model).join(ratings.where("doc_id % 2 = 1"), "doc_id").toPandas()
    best, rest = got[got.grade == 2], got[got.grade < 2]
    auc = np.mean([(best["tail"].to_numpy() > x).mean() for x in rest["tail"]])
    assert auc > 0.9 and best.kept.mean() > 0.95 and best.expected_grade.mean() > rest.expected_grade.mean() + 0.3
    again = qc.fit(docs, ratings.where("doc_id % 2 = 0"))
    assert np.array_equal(model.weights, again.weights)


def test_gradient_of_the_ordinal_loss():
    """Fitting pulls three separable grades apart, in order."""
    rows = [(np.array([g]), np.array([1.0], np.float32)) for g in (0, 1, 2) for _ in range(60)]
    model = qc.fit_arrays(rows, np.repeat([3, 4, 5], 60), epochs=60)
    tails = model.tails(model.weights[:3].astype(float))
    expected = model.lowest + tails.sum(1)
    assert abs(expected[0] - 3) < 0.3 and abs(expected[1] - 4) < 0.3 and abs(expected[2] - 5) < 0.3


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "some text", 0), (3, "x" * 100_000, 0), (3, "x" * 100_000, 0)], DOCS + ", kept int")
    for ratings in ([], [(1, 2)], [(1, 1), (3, 2), (None, 1), (2, None)]):
        got = qc.score(docs, qc.fit(docs, spark.createDataFrame(ratings, "doc_id long, grade int"))).collect()
        assert len(got) == 5 and all(0 <= r["tail"] <= 1 for r in got)
    empty = spark.createDataFrame([], DOCS)
    assert qc.score(empty, qc.fit(empty, spark.createDataFrame([], "doc_id long, grade int"))).count() == 0


def test_a_bounded_sample_is_neither_too_large_nor_empty(spark):
    from pyspark.sql import functions as F

    from tamis.llm.common import bounded_sample

    ids = spark.range(20_000)
    for most in (3, 100, 5000):
        for slots in (2, 16, 1024):
            got = bounded_sample(ids, F.col("id"), most, slots=slots)
            assert most / 2 <= got.count() <= most
    assert bounded_sample(ids, F.col("id"), 30_000).count() == 20_000
    weighed = bounded_sample(ids, F.col("id"), 10_000, F.col("id") % 7)
    assert 5_000 <= weighed.agg(F.sum(F.col("id") % 7)).first()[0] <= 10_000
    assert bounded_sample(ids.limit(0), F.col("id"), 5).count() == 0
