"""Scanning and cleaning a corpus end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, dedup, embed, quality
from ..settings import DEFAULTS, Settings
from .storage import written

METHODS = ("two_stage", "embedding", "jaccard")


@dataclass
class Scan:
    """Lazy tables of one scan; links (a, b) and stats are written once and shared by what follows. The links are enough for
    the clusters; all similar pairs are made when somebody asks for them."""

    docs: DataFrame
    stats: DataFrame
    links: DataFrame
    clusters: DataFrame
    settings: Settings
    all_pairs: Callable[[], DataFrame]

    @cached_property
    def pairs(self) -> DataFrame:
        """a, b, score."""
        return self.all_pairs()

    def summary(self) -> DataFrame:
        """One row: the totals of text quality and duplicates, and overall_quality."""
        n = self.stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("q"), F.coalesce(F.sum(F.size(quality.issue_array(self.settings))), F.lit(0)).alias("i"))
        sizes = self.clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
        dup = sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("removable"))
        both = n.join(F.broadcast(dup))  # one row each
        return both.select(
            F.col("n").alias("total_documents"), F.col("q").alias("avg_quality_score"), F.col("i").alias("total_issues"), "clusters",
            F.col("members").alias("total_duplicates"), F.col("removable").alias("unique_duplicates"),
            quality.overall_quality(F.col("n"), F.col("members"), F.col("q"), F.col("i")).alias("overall_quality"),
            quality.recommendation(F.col("n"), F.col("i"), F.col("q")).alias("recommendation"),
        )

    def issues_breakdown(self) -> DataFrame:
        """issue_type, n, with the removable duplicates as one type more."""
        dup = self.clusters.agg((F.count("*") - F.count_distinct("cluster_id")).alias("n")).select(F.lit("duplicates").alias("issue_type"), "n")
        return quality.issues_by_type(quality.issues(self.stats, self.settings)).unionByName(dup)

    def clean(self, strategy: str = "moderate") -> DataFrame:
        """doc_id, reason (null: kept)."""
        return clean.decide(self.docs, strategy, self.clusters, self.settings)


def scan(
    docs: DataFrame, provider: embed.Provider | None = None, method: str = "two_stage", threshold: float | None = None, s: Settings = DEFAULTS,
    stats: Callable[[DataFrame, Settings], DataFrame] = quality.doc_stats, progress: Callable[[str, float], None] | None = None,
) -> Scan:
    """threshold: the caller's, else the provider's own. stats: what computes the facts of texts. progress: is told each
    step and the share that is done; Spark's job descriptions name the steps as well."""

    def step(name: str, done: float) -> None:
        docs.sparkSession.sparkContext.setJobDescription(f"scan: {name}" if done < 1 else None)
        if progress:
            progress(name, done)

    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    p = provider or embed.provider("hashed")
    least = p.duplicate_threshold if threshold is None else threshold
    step("duplicates", 0.0)
    if method == "jaccard":
        links, all_pairs = written(dedup.jaccard_links(docs, least, s)), lambda: written(dedup.jaccard_pairs(docs, least, s))
    else:
        vectors = written(p.embed(dedup.representatives(docs)))
        step("pairs", 0.3)
        pairs = dedup.two_stage_pairs(docs, vectors, least, s) if method == "two_stage" else dedup.cosine_pairs(vectors, least)
        links = written(pairs)
        all_pairs = lambda: links
    step("text quality", 0.6)
    facts = written(stats(docs, s))
    step("clusters", 0.8)
    clusters = written(dedup.document_clusters(docs, links))
    step("done", 1.0)
    return Scan(docs, facts, links, clusters, s, all_pairs)
