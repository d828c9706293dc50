import math
import random
from collections import Counter

import numpy as np
import pytest

from tamis.functions import text as T
from tamis.operators import diagnose, metrics, retrieval

HITS, QRELS = "query_id string, rank int, doc_id string, score double", "query_id string, doc_id string"


def hits(spark, lists):
    return spark.createDataFrame([(q, i + 1, d, 1.0 / (i + 1)) for q, ds in lists.items() for i, d in enumerate(ds)], HITS)


def qrels(spark, answers):
    return spark.createDataFrame([(q, d) for q, ds in answers.items() for d in ds], QRELS)


def asked(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "query_id string, query string")


def test_metrics_by_hand(spark):
    h, r, q = hits(spark, {"q": ["a", "x", "y", "z"], "e": ["a"]}), qrels(spark, {"q": ["a", "b", "c"]}), asked(spark, "q", "e", "n")
    got = {x.query_id: x for x in metrics.per_query(h, r, q).collect()}
    assert abs(got["q"].ndcg - 0.4693) < 1e-4 and got["q"].mrr == 1 and got["q"].precision == 0.25 and abs(got["q"].recall - 1 / 3) < 1e-5 and got["q"].hit_rate == 1
    assert all(getattr(got[i], m) == 0 for i in "en" for m in metrics.METRICS)
    assert abs(metrics.average(metrics.per_query(h, r, q)).first().hit_rate - 1 / 3) < 1e-5
    cut = metrics.per_query(hits(spark, {"q": ["x", "y", "a"]}), r, asked(spark, "q"), 2).first()
    assert cut.ndcg == cut.mrr == cut.recall == 0
    assert metrics.average(metrics.per_query(h, r, q.limit(0))).first().ndcg == 0


def test_fusion(spark):
    a, b = hits(spark, {"q": ["a", "b"]}), hits(spark, {"q": ["b", "c"]})
    got = [(x.doc_id, x.score) for x in retrieval.fuse([a, b]).orderBy("rank").collect()]
    assert [d for d, _ in got] == ["b", "a", "c"] and abs(got[0][1] - (1 / 62 + 1 / 61)) < 1e-8


def test_bm25_by_hand_with_zero_scores(spark):
    docs = spark.createDataFrame([("d1", "cat dog"), ("d2", "cat cat bird"), ("d3", "fish"), ("d4", None)], "doc_id string, text string")
    got = [(r.doc_id, r.score) for r in retrieval.bm25_topk(docs, spark.createDataFrame([("q", "bird bird")], "query_id string, query string"), 3).orderBy("rank").collect()]
    idf = math.log(3.5) - math.log(1.5)
    want = 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 1.5))
    assert [d for d, _ in got] == ["d2", "d1", "d3"] and abs(got[0][1] - want) < 1e-5 and got[1][1] == 0
    assert retrieval.bm25_topk(docs, spark.createDataFrame([("q", "bird")], "query_id string, query string"), 3, zero_scores=False).count() == 1


def test_dense_topk_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((40, 5)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "doc_id long, embedding array<float>")
    monkeypatch.setattr(retrieval, "QUERIES", 2)
    got = retrieval.dense_topk(vectors, vectors.where("doc_id < 5").withColumnRenamed("doc_id", "query_id"), 3).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        want = np.argsort(-(unit @ unit[q]))[:3].tolist()
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert retrieval.dense_topk(vectors, vectors.limit(0).withColumnRenamed("doc_id", "query_id"), 3).count() == 0


def test_distractors_and_failures(spark):
    h = hits(spark, {"one": ["a", "x"], "three": ["x", "y", "a"], "never": ["x", "y"], "none": ["x"]})
    r, q = qrels(spark, {"one": ["a"], "three": ["a"], "never": ["b"]}), asked(spark, "one", "three", "never")
    found = {x.doc_id: x.displacements for x in diagnose.distractors(diagnose.displacements(h, r)).collect()}
    assert found == {"x": 2, "y": 2}
    corpus = spark.createDataFrame([("a",), ("x",), ("y",)], "doc_id string")
    outcome = {x.query_id: x.outcome for x in diagnose.failure_classes(h, r, corpus, q).collect()}
    assert outcome == {"one": "ok", "three": "ok", "never": "fp1_missing_content"}
    assert {x.query_id: x.outcome for x in diagnose.failure_classes(h, r, corpus, q, 2).collect()}["three"] == "fp2_missed_top_ranked"
    assert [x.query_id for x in diagnose.answers_destroyed(r, corpus).collect()] == ["never"]


def test_fact_recall_and_attribution(spark):
    labels = spark.createDataFrame([("a", "gold", "t1", True), ("c", "exact_dup", "t1", True), ("r", "related", "t1", False), ("z", "other", "none", True)], "doc_id string, doc_class string, topic_id string, answer_bearing boolean")
    h = hits(spark, {"q": ["r", "z"], "p": ["c"]})
    got = {x.query_id: x.fact_recall for x in diagnose.fact_recall(h, qrels(spark, {"q": ["a"], "p": ["a", "c"], "n": ["z"]}), labels).collect()}
    assert got == {"q": 0.0, "p": 1.0}
    docs = spark.createDataFrame([("a", "same text"), ("c", "other words"), ("r", "same  text"), ("z", "z")], "doc_id string, text string")
    gone = spark.createDataFrame([("a", None), ("c", "duplicate"), ("r", "duplicate"), ("z", "too_short")], "doc_id string, reason string")
    row = diagnose.cleaning_attribution(docs, gone, labels).first()
    assert (row.dup_removed, row.right, row.found, row.dedup_precision, row.dedup_recall) == (2, 2, 1, 1.0, 1.0)


def test_bootstrap_equals_numpy(spark):
    v = np.random.default_rng(1).random(30)
    scores = spark.createDataFrame([("x", i, float(a)) for i, a in enumerate(v)], "arm string, query_id long, ndcg double")
    row = metrics.bootstrap_ci(scores, ["arm"], "ndcg").first()
    rng = np.random.RandomState(0)
    means = [v[rng.randint(0, 30, 30)].mean() for _ in range(2000)]
    assert abs(row.low - np.percentile(means, 2.5)) < 1e-12 and abs(row.high - np.percentile(means, 97.5)) < 1e-12


def test_passages_and_rerank(spark):
    docs = spark.createDataFrame([("d1", "xx needle in here"), ("d2", None), ("d3", "here needle is in hay")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "needle in"), ("p", "needle in"), ("e", "")], "query_id string, query string")
    assert {(r.query_id, r.doc_id) for r in retrieval.passages_in(docs, q).collect()} == {("q", "d1"), ("p", "d1")}
    got = retrieval.rerank(hits(spark, {"q": ["d2", "d3", "gone"]}), q, docs, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.rerank_score) for r in got] == [("d3", 1.0), ("d2", 0.0)]


def test_wrong_arguments(spark):
    from tamis.plans import evaluate

    with pytest.raises(ValueError):
        evaluate.retrieve(evaluate.Corpus("x", spark.range(1)), asked(spark, "q"), "sparse")
    with pytest.raises(ValueError):
        evaluate.retrieve(evaluate.Corpus("x", spark.range(1)), asked(spark, "q"), "dense")


def test_search_tokens_in_python_equal_the_column(spark):
    odd = ["The cat, the-CAT 42", None, "", "한국어 문서입니다 a1한글b 가", "K İ ß Ⅷ ² É é x", "a\u0000b\tc\n", "가나", "...", "ŞAŞ naïve 日本 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    for r in df.select("t", T.search_tokens(T.text_of("t")).alias("w")).collect():
        assert [x.decode() for x in T.python_search_tokens(r.t)] == r.w


@pytest.mark.parametrize("zero_scores", [True, False])
def test_bm25_equals_its_definition_and_writes_no_row_for_a_query_and_a_document(spark, monkeypatch, zero_scores):
    rng, sizes = random.Random(3), []
    words = [f"w{i}" for i in range(60)]
    docs = [(f"d{i:03d}", " ".join(rng.choices(words[: 5 if i % 3 else 60], k=rng.randrange(0, 30)))) for i in range(200)] + [("e", None)]
    asked = [(q, " ".join(rng.choices(words, k=4)) if q % 5 else " ".join(words[:2] * 2) if q else "nothing") for q in range(20)]
    real = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df: sizes.append((out := real(df)).count()) or out)
    monkeypatch.setattr(retrieval, "QUERIES", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = retrieval.bm25_topk(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(asked, "query_id int, query string"), 5, zero_scores).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(sizes) < 200  # before, 201 token lists and thousands of scores

    own = {i: (t or "").split() for i, t in docs}
    df = Counter(w for t in own.values() for w in set(t))
    raw = {w: math.log(len(own) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    mean = sum(map(len, own.values())) / len(own)
    want = set()
    for q, text in asked:
        scored = [(-round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in text.split()), 6), i) for i, t in own.items() if zero_scores or set(t) & set(text.split())]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:5])}
    assert {(r.query_id, r["rank"], r.doc_id, r.score) for r in got} == want


@pytest.mark.parametrize("most", [0, 100])
def test_rows_meet_few_or_many_ids(spark, monkeypatch, most):
    from tamis.plans import storage

    monkeypatch.setattr(storage, "IDS", most)
    rows, ids = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id int, text string"), spark.createDataFrame([(2,), (2,), (None,)], "doc_id int")
    assert [r.text for r in storage.only(rows, ids).collect()] == ["b"]
    assert {r.text for r in storage.without(rows, ids).collect()} == {"a", "c"}
