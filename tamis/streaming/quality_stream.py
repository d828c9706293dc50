"""Quality facts, cleaning and duplicates over streams of documents (doc_id, text, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality
from ..settings import DEFAULTS, Settings


def stats(stream: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """doc_stats of each document as it comes; no state."""
    return quality.doc_stats(stream, s)


def first_copies(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first document of each normal form within the watermark; the state is two hashes per form."""
    form = T.normal_form(T.text_of("text"))
    keyed = stream.withColumn("_h", F.xxhash64(form)).withColumn("_g", F.xxhash64(F.lit(1), form))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["_h", "_g"]).drop("_h", "_g")


def issue_counts(stream: DataFrame, window: str = "5 minutes", delay: str = "10 minutes", s: Settings = DEFAULTS) -> DataFrame:
    """window, issue_type, n per window of event time, late documents up to the watermark included."""
    t = T.text_of("text")
    words = T.words(t)
    facts = stream.withWatermark("ts", delay).select(
        "doc_id", "ts", T.char_count(t).alias("char_count"), F.size(words).alias("word_count"), T.sentence_count(t).alias("sentence_count"),
        F.when(F.char_length(t) > 0, T.special_chars(t) / F.char_length(t)).otherwise(0.0).alias("special_char_ratio"),
        T.trigram_repetition(words, s.repetition_min_words).alias("repetition"), t.rlike("[.!?]").alias("has_stop"),
    )
    found = facts.select("ts", F.explode(quality.issue_array(s)).alias("issue"))
    return found.groupBy(F.window("ts", window), F.col("issue.issue_type").alias("issue_type")).agg(F.count("*").alias("n"))
