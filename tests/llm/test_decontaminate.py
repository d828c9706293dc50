import random

import numpy as np

from helpers import DOCS
from tamis.llm import decontaminate as d

ITEMS = "item_id long, text string"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence_matches_the_plain_rule():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert d.common_subsequence(a, b) == plain_lcs(a, b)


def test_every_passage_of_the_table_is_found_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join((t or "").lower().split())
    texts = [(r.doc_id, plain(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = {(i, r.item_id) for r in items.collect() for i, t in texts if plain(r.text) in t}
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    assert want and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def test_paraphrases_answers_and_long_items(spark):
    rng = random.Random(4)
    common = sentence(rng, 40)
    fill = lambda: f"{sentence(rng, 30)} {common} {sentence(rng, 30)}"
    item = sentence(rng, 30).split()
    loose = " ".join(w if k % 3 and k not in (1, 4) or k > 22 else sentence(rng, 1) for k, w in enumerate(item))  # two words in three, the answer whole
    lost = " ".join(w if k % 3 else sentence(rng, 1) for k, w in enumerate(item))
    long_item = sentence(rng, 400)
    rows = [(i, fill()) for i in range(60)]
    rows += [(100, f"{fill()} {' '.join(item).upper()}! {fill()}"), (101, f"{fill()} {loose} {fill()}"), (102, f"{fill()} {lost} {fill()}"), (103, f"{fill()}\n{long_item}")]
    rows += [(104, None), (105, ""), (None, " ".join(item)), (106, " ".join(item)), (106, " ".join(item)), (107, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", cosine int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, long_item), (3, None), (4, ""), (5, "..."), (6, sentence(rng, 20))], ITEMS)
    got = sorted((r.doc_id or -1, r.item_id) for r in d.leaks(docs, items).collect())
    assert got == [(-1, 1), (100, 1), (101, 1), (103, 2), (106, 1), (106, 1)]
    kept = {r.doc_id for r in d.clean(docs, items).collect()}
    assert kept == {*range(60), 102, 104, 105, 107}
    named = items.withColumnRenamed("text", "q").selectExpr("item_id", "q AS text", "'no such words' AS answer")
    assert 101 not in {r.doc_id for r in d.leaks(docs, named, answer_col="answer").collect()}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert d.leaks(docs, items).count() == 0
    full = spark.createDataFrame([(1, "some words here")], DOCS)
    assert d.leaks(full, items).count() == 0 and d.leaks(docs, spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


def test_vectors_are_fitted_on_every_block_of_a_large_input(spark, monkeypatch):
    seen = []
    real = d.right_vectors

    def spy(hashed, *rest):
        seen.append(hashed.count())
        return real(hashed, *rest)

    monkeypatch.setattr(d, "right_vectors", spy)
    # 420,000 blocks or more, over the bound that the fit once had; the texts differ by their first word
    docs = spark.range(4200).selectExpr("id AS doc_id", "concat('first', id, ' ', repeat('some words of a text ', 480)) AS text")
    d.leaks(docs, spark.createDataFrame([(1, "some item of the benchmark")], ITEMS))
    assert seen == [4200]


def test_sums_by_block_and_by_term_match_the_plain_rule():
    rng = np.random.default_rng(3)
    b = d.Blocks([d.words(" ".join(f"w{k}" for k in rng.zipf(1.3, n))).astype("<u4").tobytes() for n in (0, 1, 24, 25, 700, 9000)])
    rows = rng.standard_normal((d.TERMS, 3))
    want = np.zeros((len(b.text), 3))
    np.add.at(want, b.block, rows[b.term])
    assert np.allclose(b.sums(rows), want)
    total, plain = np.zeros((d.TERMS, 3)), np.zeros((d.TERMS, 3))
    b.add_to_terms(want, total)
    np.add.at(plain, b.term, want[b.block])
    assert np.allclose(total, plain)


def test_the_filter_drops_no_pair_that_the_subsequence_accepts():
    rng = random.Random(6)
    for common_share in (0.2, 0.5, 0.8):
        vocab = [f"c{k}" for k in range(12)]
        draw = lambda n: [rng.choice(vocab) if rng.random() < common_share else sentence(rng, 1) for _ in range(n)]
        items = [draw(rng.choice([3, 15, 38, 59, 71, 200])) for _ in range(60)]
        texts = []
        for w in items:  # every other rare word is changed, then common ones, to 0.6 of the item
            keep = sorted(sorted(range(len(w)), key=lambda k: (w[k] not in vocab, rng.random()))[: -(-len(w) * 6 // 10)])
            texts.append(draw(rng.randrange(0, 60)) + [w[k] if k in keep else sentence(rng, 1) for k in range(len(w))] + draw(40))
        numbers = [d.words(" ".join(w)) for w in items]
        b = d.Blocks([d.words(" ".join(t)).astype("<u4").tobytes() for t in texts])
        rarity = np.ones(d.TERMS)
        rarity[d.words(" ".join(vocab)) % d.TERMS] = 0
        passed = d.Telling(numbers, rarity, d.PARAPHRASE).enough(b)
        ends, accepted = np.r_[b.starts, len(b.word)], 0
        for k in range(len(b.text)):
            t = b.text[k]
            for i, w in enumerate(numbers):
                near = b.word[max(b.first[t], b.starts[k] - len(w)) : min(b.first[t + 1], ends[min(k + 2, b.first_block[t + 1])] + len(w))]
                if d.common_subsequence(w.tolist(), near.tolist()) >= d.PARAPHRASE * len(w):
                    accepted += 1
                    assert passed[k, i]
        assert accepted >= 60
        assert not passed.all()


def test_a_paraphrase_that_keeps_the_common_words_is_found(spark):
    rng = random.Random(8)
    usual = [sentence(rng, 1) for _ in range(8)]
    items = [[rng.choice(usual) if k % 3 else sentence(rng, 1) for k in range(36)] for _ in range(150)]
    fill = lambda n: [sentence(rng, 1) for _ in range(n)]
    # three in four words stay; those that go are rare, so a quarter of the rare words is left
    texts = [fill(30) + [sentence(rng, 1) if k % 3 == 0 and k % 4 else x for k, x in enumerate(w)] + fill(30) for w in items[:40]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench, cosine=-1.0).collect()}
    assert {(i, i) for i in range(40)} <= got
