"""Cleaning: each document gets the first reason for which it goes, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.storage import without, written
from ..settings import DEFAULTS, Settings
from . import quality

STRATEGIES = ("conservative", "moderate", "aggressive")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, first_id of every document whose normal form an earlier one has.

    The normal form is hashed (two 64-bit hashes) before the shuffle; the first of a form is found with map-side
    aggregation, so a form that a third of all documents share is one row per task.
    """
    form = T.normal_form(T.text_of("text"))
    own = written(docs.select("doc_id", F.xxhash64(form).alias("h"), F.xxhash64(F.lit(1), form).alias("g")))  # else the forms are made twice
    first = own.groupBy("h", "g").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return own.join(first.drop("n"), ["h", "g"]).where("doc_id <> first_id").select("doc_id", "first_id")


def decide(docs: DataFrame, strategy: str = "moderate", clusters: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """doc_id, reason (null: kept). clusters: doc_id, cluster_id of near duplicates; conservative cleaning ignores them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if strategy == "conservative":
        gone = exact_duplicates(docs).select("doc_id", F.lit("exact_duplicate").alias("reason"))
        return docs.select("doc_id").join(gone, "doc_id", "left")
    names = ["too_short"] if strategy == "moderate" else ["too_short", "low_word_count", "high_special_char_ratio"]
    found = F.filter(quality.issue_array(s), lambda x: x["issue_type"].isin(names))
    # written once: a filter on the reason would else be pushed down and have every fact of a text computed again
    stats = written(quality.doc_stats(docs, s).select("doc_id", F.get(F.transform(found, lambda x: x["issue_type"]), 0).alias("issue")))
    if clusters is None:
        return stats.select("doc_id", F.col("issue").alias("reason"))
    keep = cleanest(docs, clusters)
    gone = clusters.join(keep, "cluster_id").where("doc_id <> keep_id").select("doc_id", F.lit("duplicate").alias("dup"))
    return stats.join(gone, "doc_id", "left").select("doc_id", F.coalesce("dup", "issue").alias("reason"))


def cleanest(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_id, keep_id: the member with the fewest typographic artifacts, then the shortest, then of least id."""
    facts = docs.select("doc_id", T.typographic_artifacts(T.text_of("text")).alias("a"), T.char_count(T.text_of("text")).alias("n"))
    return clusters.join(facts, "doc_id", "left").groupBy("cluster_id").agg(F.min_by("doc_id", F.struct(F.coalesce("a", F.lit(0)), F.coalesce("n", F.lit(0)), "doc_id")).alias("keep_id"))


def deduplicate_only(docs: DataFrame, clusters: DataFrame, select: str = "first") -> DataFrame:
    """doc_id, reason: of each cluster the first member stays, or the longest (the first of the longest)."""
    if select not in ("first", "longest"):
        raise ValueError(f"select must be first or longest, not {select!r}")
    if select == "first":
        keep = clusters.groupBy("cluster_id").agg(F.min("doc_id").alias("keep_id"))
    else:
        sized = clusters.join(docs.select("doc_id", T.char_count(T.text_of("text")).alias("n")), "doc_id")
        keep = sized.groupBy("cluster_id").agg(F.min_by("doc_id", F.struct(-F.col("n"), F.col("doc_id"))).alias("keep_id"))
    gone = clusters.join(keep, "cluster_id").where("doc_id <> keep_id").select("doc_id", F.lit("duplicate").alias("reason"))
    return docs.select("doc_id").join(gone, "doc_id", "left")


def filter_by_length(docs: DataFrame, min_length: int | None = None, max_length: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """doc_id, reason. A max_length of 0 or None sets no limit; a min_length of 0 is one."""
    n, least = T.char_count(T.text_of("text")), s.min_length if min_length is None else min_length
    reason = F.when(n < least, "too_short")
    return docs.select("doc_id", (reason.when(n > max_length, "too_long") if max_length else reason).alias("reason"))


def filter_by_quality_score(docs: DataFrame, stats: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, reason; a document without a score counts as 1."""
    met = docs.select("doc_id").join(stats.select("doc_id", "quality_score"), "doc_id", "left")
    return met.select("doc_id", F.when(F.coalesce("quality_score", F.lit(1.0)) < least, "low_quality").alias("reason"))


def kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    return without(docs, decisions.where("reason is not null"))


def removed(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The removed rows with their true reason."""
    return docs.join(decisions.where("reason is not null"), "doc_id")


def summary(decisions: DataFrame) -> DataFrame:
    """reason ("kept" for what stays), n, percent of all documents."""
    counts = decisions.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)  # a row per reason
