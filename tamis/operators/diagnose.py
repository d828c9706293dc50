"""Why retrieval fails: distractors, missing content, missed ranks, and what cleaning removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DUPLICATE_CLASSES = ("exact_dup", "near_dup")
DUPLICATE_REASONS = ("duplicate", "exact_duplicate")


def displacements(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, rank: wrong hits above the first right one (all of them if there is none); queries without answers are left out."""
    asked = qrels.select("query_id").distinct()
    right = qrels.select("query_id", "doc_id", F.lit(1).alias("rel"))
    cut = hits.where(F.col("rank") <= k).select("query_id", "doc_id", "rank").join(asked, "query_id", "left_semi").join(right, ["query_id", "doc_id"], "left")
    first = cut.where("rel = 1").groupBy("query_id").agg(F.min("rank").alias("first"))
    return cut.join(first, "query_id", "left").where(F.col("rel").isNull() & (F.col("first").isNull() | (F.col("rank") < F.col("first")))).select("query_id", "doc_id", "rank")


def distractors(displaced: DataFrame, n: int | None = None) -> DataFrame:
    """doc_id, displacements, queries (sorted); the n worst if n is given, ties by doc_id."""
    found = displaced.groupBy("doc_id").agg(F.count("*").alias("displacements"), F.sort_array(F.collect_list("query_id")).alias("queries"))
    return found if n is None else found.orderBy(F.desc("displacements"), "doc_id").limit(n)


def distractor_classes(found: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, displacements, doc_class ("unknown" without a label) of distractors."""
    met = found.select("doc_id", "displacements").join(labels.select("doc_id", "doc_class"), "doc_id", "left")
    return met.select("doc_id", "displacements", F.coalesce("doc_class", F.lit("unknown")).alias("doc_class"))


def class_counts(labels: DataFrame) -> DataFrame:
    """doc_class, n."""
    return labels.groupBy("doc_class").agg(F.count("*").alias("n"))


def present_qrels(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """The answers that the corpus still has."""
    return qrels.select("query_id", "doc_id").join(corpus.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id")


def answers_destroyed(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, answers, present of the queries that had answers and have none in the corpus."""
    left = present_qrels(qrels, corpus).groupBy("query_id").agg(F.count("*").alias("present"))
    every = qrels.groupBy("query_id").agg(F.count("*").alias("answers")).join(left, "query_id", "left")
    return every.select("query_id", "answers", F.coalesce("present", F.lit(0)).alias("present")).where("present = 0")


def failure_classes(hits: DataFrame, qrels: DataFrame, corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, outcome: fp1_missing_content, fp2_missed_top_ranked or ok, by the answers before any cleaning."""
    present = present_qrels(qrels, corpus)
    some = present.select("query_id").distinct().withColumn("some", F.lit(True))
    found = hits.where(F.col("rank") <= k).select("query_id", "doc_id").join(present, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("found", F.lit(True))
    every = queries.select("query_id").join(some, "query_id", "left").join(found, "query_id", "left")
    return every.select("query_id", F.when(F.col("some").isNull(), "fp1_missing_content").when(F.col("found").isNull(), "fp2_missed_top_ranked").otherwise("ok").alias("outcome"))


def fact_recall(hits: DataFrame, qrels: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, facts, covered, fact_recall: topics of the answers that an answer-bearing hit covers; queries without topics are left out.

    labels: doc_id, topic_id ("none" for no topic), answer_bearing."""
    wanted = qrels.join(labels.where("topic_id <> 'none'"), "doc_id").select("query_id", "topic_id").distinct()
    had = hits.where(F.col("rank") <= k).join(labels.where("answer_bearing"), "doc_id").select("query_id", "topic_id").distinct().withColumn("hit", F.lit(1))
    met = wanted.join(had, ["query_id", "topic_id"], "left").groupBy("query_id").agg(F.count("*").alias("facts"), F.count("hit").alias("covered"))
    return met.withColumn("fact_recall", F.round(F.col("covered") / F.col("facts"), 6))


def removed_by_class(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_class ("unknown" without a label), removed."""
    gone = decisions.where("reason is not null").select("doc_id").join(labels.select("doc_id", "doc_class"), "doc_id", "left")
    return gone.groupBy(F.coalesce("doc_class", F.lit("unknown")).alias("doc_class")).agg(F.count("*").alias("removed"))


def cleaning_attribution(docs: DataFrame, decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: dup_removed, right, found, true_dups, dedup_precision, dedup_recall.

    Precision counts a removal as right if the label says duplicate or a kept document has the same normal form; recall
    counts labels only. Null where there is nothing to divide by."""
    form = T.normal_form(T.text_of("text"))
    own = docs.select("doc_id", F.xxhash64(form).alias("h"), F.xxhash64(F.lit(1), form).alias("g")).join(decisions, "doc_id")
    kept = own.where("reason is null").select("h", "g").distinct().withColumn("same", F.lit(True))
    dup = labels.where(F.col("doc_class").isin(*DUPLICATE_CLASSES)).select("doc_id", F.lit(True).alias("labelled"))
    gone = own.where(F.col("reason").isin(*DUPLICATE_REASONS)).join(dup, "doc_id", "left").join(kept, ["h", "g"], "left")
    sums = gone.agg(F.count("*").alias("dup_removed"), F.count_if(F.coalesce("labelled", "same", F.lit(False))).alias("right"), F.count("labelled").alias("found"))
    all_ = sums.join(F.broadcast(dup.agg(F.count("*").alias("true_dups"))))  # one row each
    share = lambda a, b: F.round(F.col(a) / F.when(F.col(b) > 0, F.col(b)), 6)
    return all_.withColumn("dedup_precision", share("right", "dup_removed")).withColumn("dedup_recall", share("found", "true_dups"))
