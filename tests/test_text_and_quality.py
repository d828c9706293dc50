import pytest
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.functions import vectors as V
from tamis.operators import quality
from tamis.settings import Settings

DOCS = "doc_id long, text string"


def issues_of(spark, text, **s):
    df = spark.createDataFrame([(1, text)], DOCS)
    return [r.issue_type for r in quality.issues(quality.doc_stats(df, Settings(**s)), Settings(**s)).orderBy("ord").collect()]


def test_issues_on_and_off(spark):
    fine = "A plain sentence with enough words in it. And one more of them."
    assert issues_of(spark, fine) == []
    assert issues_of(spark, "hi") == ["too_short", "low_word_count"]
    assert issues_of(spark, None) == ["too_short", "low_word_count"]
    assert issues_of(spark, "Word after word. " * 200) == ["too_long", "repetitive_content"]
    assert issues_of(spark, "@@## $$%% ^^&& **(( text here now") == ["high_special_char_ratio"]
    assert issues_of(spark, " ".join(f"w{i}" for i in range(20))) == ["missing_punctuation"]
    assert issues_of(spark, " ".join(f"w{i}" for i in range(19))) == []


def test_stats_of_unicode_text(spark):
    df = spark.createDataFrame([(1, "Zwei Wörter! 가😀?  Und"), (2, "")], DOCS)
    a, b = quality.doc_stats(df).orderBy("doc_id").collect()
    assert (a.char_count, a.word_count, a.sentence_count) == (21, 4, 3)
    assert abs(a.avg_word_length - 17 / 4) < 1e-12 and abs(a.special_char_ratio - 1 / 21) < 1e-12
    assert (b.char_count, b.word_count, b.avg_word_length, b.special_char_ratio, b.repetition) == (0, 0, 0.0, 0.0, None)


def test_quality_score_products(spark):
    make = lambda t: quality.doc_stats(spark.createDataFrame([(1, t)], DOCS)).first().quality_score
    assert abs(make("abc") - 0.12) < 1e-12
    assert make("One two three four five six.") == 1.0
    assert abs(make("~~~~ @@@@ ####") - 0.5) < 1e-12


def test_summaries_and_histogram(spark):
    stats = quality.doc_stats(spark.createDataFrame([(i, "x" * 100) for i in range(5)], DOCS))
    bins = quality.length_histogram(stats, 4).orderBy("bin").collect()
    assert [r.n for r in bins] == [0, 0, 5, 0] and bins[0].low == 99.5 and bins[-1].high == 100.5
    assert {r["bin"]: r.n for r in quality.length_distribution(stats).collect()} == {"0-50": 0, "50-200": 5, "200-500": 0, "500-1000": 0, "1000+": 0}
    empty = quality.quick_scan(spark.createDataFrame([], DOCS)).first()
    assert (empty.total_documents, empty.avg_quality_score, empty.recommendation) == (0, 0.0, None)
    assert quality.length_histogram(quality.doc_stats(spark.createDataFrame([], DOCS))).count() == 0


def test_text_functions(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c).first()[0]
    t = F.col("t")
    assert one(T.normal_form(t), "\t a  b\n\nc ") == "a b c"
    assert one(T.typographic_artifacts(t), "a  b . c ,d") == 3
    assert one(T.search_tokens(t), "Ab-1 재부팅을 가나 ab") == ["ab", "1", "재부팅을", "재부", "부팅", "팅을", "가나", "ab"]
    assert one(T.percent_change(F.lit(0.0), F.lit(2.0)), "") == 100.0 and one(T.percent_change(F.lit(2.0), F.lit(1.0)), "") == -50.0
    assert one(T.with_prefix(t, "query", "e5-small"), "q") == "query: q" and one(T.with_prefix(t, "query"), "q") == "q"


def test_cosine_of_zero_vectors(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b")).alias("z"), V.cosine(F.col("b"), F.col("b")).alias("o"), V.normalise(F.col("a")).alias("n")).first()
    assert row.z == 0.0 and abs(row.o - 1) < 1e-9 and row.n == [0.0, 0.0]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(jaccard=0)
    assert Settings(max_length=None).max_length is None


def test_streams(spark, tmp_path):
    from tamis.streaming import quality_stream as qs

    rows = spark.range(6).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same  text here' ELSE concat('own text number ', id) END AS text", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("stats", qs.stats(stream), "append"), ("first", qs.first_copies(stream), "append"), ("issues", qs.issue_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert spark.table("stats").count() == 6
    assert spark.table("first").count() == 4
