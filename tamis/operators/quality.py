"""Quality facts of documents, the issues that follow from them, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULTS, Settings

#: In the order in which issues are raised; cleaning gives the first as the reason.
ISSUES = ("too_short", "too_long", "low_word_count", "high_special_char_ratio", "missing_punctuation", "repetitive_content")
SEVERITY = {"too_short": "error", "low_word_count": "error"}


def quality_score(chars: Column, words: Column, sentences: Column, special: Column, s: Settings = DEFAULTS) -> Column:
    long = F.lit(False) if not s.max_length else chars > s.max_length
    per_sentence = words / F.when(sentences > 0, sentences)
    score = F.when(chars < s.min_length, 0.3).when(long, 0.7).otherwise(1.0)
    score = score * F.when(words < s.min_words, 0.4).otherwise(1.0) * F.when(special > s.max_special_ratio, 0.5).otherwise(1.0)
    score = score * F.when((words > 0) & per_sentence.between(5, 25), 1.1).otherwise(1.0)
    return F.least(F.lit(1.0), score)


def doc_stats(docs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """doc_id, char_count, word_count, sentence_count, avg_word_length, special_char_ratio, quality_score, repetition, has_stop."""
    t = F.col("_t")
    own = docs.select("doc_id", T.text_of("text").alias("_t")).withColumn("_w", T.words(t))
    own = own.select(
        "doc_id",
        T.char_count(t).alias("char_count"),
        F.size("_w").alias("word_count"),
        T.sentence_count(t).alias("sentence_count"),
        F.when(F.size("_w") > 0, T.word_chars(t) / F.size("_w")).otherwise(0.0).alias("avg_word_length"),
        F.when(F.char_length(t) > 0, T.special_chars(t) / F.char_length(t)).otherwise(0.0).alias("special_char_ratio"),
        T.trigram_repetition(F.col("_w"), s.repetition_min_words).alias("repetition"),
        t.rlike("[.!?]").alias("has_stop"),
    )
    score = quality_score(F.col("char_count"), F.col("word_count"), F.col("sentence_count"), F.col("special_char_ratio"), s)
    return own.withColumn("quality_score", score)


def issue_array(s: Settings = DEFAULTS) -> Column:
    """Of doc_stats columns: the issues of a document, in the order of ISSUES."""
    when = {
        "too_short": (F.col("char_count") < s.min_length, F.col("char_count")),
        "too_long": (F.lit(False) if not s.max_length else F.col("char_count") > s.max_length, F.col("char_count")),
        "low_word_count": (F.col("word_count") < s.min_words, F.col("word_count")),
        "high_special_char_ratio": (F.col("special_char_ratio") > s.max_special_ratio, F.col("special_char_ratio")),
        "missing_punctuation": ((F.col("word_count") >= 20) & (F.col("sentence_count") <= 1) & ~F.col("has_stop"), F.col("word_count")),
        "repetitive_content": (F.coalesce(F.col("repetition") > s.max_repetition, F.lit(False)), F.col("repetition")),
    }
    made = [
        F.when(on, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("issue_type"), F.lit(SEVERITY.get(name, "warning")).alias("severity"), value.cast("double").alias("value")))
        for i, (name, (on, value)) in enumerate((n, when[n]) for n in ISSUES)
    ]
    return F.array_compact(F.array(*made))


def issues(stats: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row per issue: doc_id, ord, issue_type, severity, value, message."""
    rows = stats.select("doc_id", F.inline(issue_array(s)))
    text = F.concat(F.regexp_replace("issue_type", "_", " "), F.lit(" ("), F.round("value", 4).cast("string"), F.lit(")"))
    return rows.withColumn("message", text)


def issues_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("issue_type").agg(F.count("*").alias("n"))


def length_distribution(stats: DataFrame) -> DataFrame:
    """bin, n for each of the five bins, zeros included."""
    counts = stats.agg(*(F.count_if(T.length_bin(F.col("char_count")) == b).alias(b) for b in T.LENGTH_BINS))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(b).alias("bin"), F.col(f"`{b}`").alias("n")) for b in T.LENGTH_BINS))))


def length_histogram(stats: DataFrame, bins: int = 20) -> DataFrame:
    """bin, low, high, n: equal widths between the least and the greatest length; the last bin is closed; one length only
    makes the range half a character wider at each end."""
    ends = stats.agg(F.min("char_count").cast("double").alias("a"), F.max("char_count").cast("double").alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("low"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("high"))
    # one row of bounds meets every document: a broadcast of one row
    at = F.least(F.lit(bins - 1), F.floor((F.col("char_count") - F.col("low")) / (F.col("high") - F.col("low")) * bins)).cast("int")
    counts = stats.select("char_count").join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    every = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", width.alias("w"))
    edges = every.select("bin", (F.col("low") + F.col("bin") * F.col("w")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("w")).alias("high"))
    return edges.join(F.broadcast(counts), "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def quality_bands(stats: DataFrame) -> DataFrame:
    band = T.quality_band(F.col("quality_score"))
    counts = stats.agg(*(F.count_if(band == b).alias(b) for b in ("low", "medium", "high")))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b in ("low", "medium", "high")))))


def recommendation(total: Column, issues_: Column, quality: Column) -> Column:
    """Null for an empty corpus."""
    return (
        F.when(total == 0, F.lit(None))
        .when((issues_ == 0) & (quality >= 0.8), "good: look for duplicates next")
        .when(issues_ / F.when(total > 0, total) > 0.2, "many issues: clean aggressively")
        .when(quality < 0.5, "low quality: review short documents and special characters")
        .otherwise("some issues: clean moderately")
    )


def quick_scan(docs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row: total_documents, avg_quality_score, total_issues, documents_with_issues, recommendation. One pass, no shuffle of texts."""
    made = doc_stats(docs, s).select("quality_score", F.size(issue_array(s)).alias("n"))
    total = made.agg(
        F.count("*").alias("total_documents"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality_score"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_issues"),
        F.count_if(F.col("n") > 0).alias("documents_with_issues"),
    )
    return total.withColumn("recommendation", recommendation(F.col("total_documents"), F.col("total_issues"), F.col("avg_quality_score")))


def overall_quality(total: Column, members: Column, quality: Column, issues_: Column) -> Column:
    """0.4 for few duplicates (twice their share counts), 0.4 for text quality, 0.2 for few issues."""
    share = lambda n: F.coalesce(n / F.when(total > 0, total), F.lit(0.0))
    return F.round(0.4 * F.greatest(F.lit(0.0), 1 - 2 * share(members)) + 0.4 * quality + 0.2 * F.greatest(F.lit(0.0), 1 - share(issues_)), 3)
