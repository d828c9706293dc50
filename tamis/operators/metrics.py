"""Rank metrics. hits: query_id, rank, doc_id; qrels: query_id, doc_id (distinct); queries: query_id, so that a query without hits or answers counts as 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

METRICS = ("ndcg", "hit_rate", "mrr", "precision", "recall")
KS = (1, 3, 5, 10, 20)


def per_query(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id and METRICS. The ideal of ndcg has all answers, min(answers, k); precision divides by what was retrieved."""
    right = qrels.select("query_id", "doc_id", F.lit(1).alias("rel"))
    cut = hits.where(F.col("rank") <= k).select("query_id", "doc_id", "rank").join(right, ["query_id", "doc_id"], "left")
    rel = F.coalesce("rel", F.lit(0))
    sums = cut.groupBy("query_id").agg(
        F.sum(rel * T.discount(F.col("rank"))).alias("dcg"),
        F.sum(rel).alias("found"),
        F.count("*").alias("n"),
        F.min(F.when(rel == 1, F.col("rank"))).alias("first"),
    )
    answers = qrels.groupBy("query_id").agg(F.count("*").alias("answers"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("answers", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + T.discount(i))
    every = queries.select("query_id").join(answers, "query_id", "left").join(sums, "query_id", "left")
    some = (F.coalesce("answers", F.lit(0)) > 0) & (F.coalesce("n", F.lit(0)) > 0)
    value = lambda c: F.round(F.when(some, c).otherwise(0.0), 6)
    return every.select(
        "query_id",
        value(F.col("dcg") / F.when(F.col("answers") > 0, ideal)).alias("ndcg"),
        value((F.col("found") > 0).cast("double")).alias("hit_rate"),
        value(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        value(F.col("found") / F.col("n")).alias("precision"),
        value(F.col("found") / F.col("answers")).alias("recall"),
    )


def average(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The unweighted means of METRICS; zeros for no queries."""
    return scores.groupBy(*(by or [])).agg(*(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS))


def summary(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """k and the means at 4 places, as reports show them. Lists of queries and answers that don't fit are an error."""
    stray = qrels.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_anti").first()
    if stray:
        raise ValueError(f"there are answers to a query that isn't asked: {stray.query_id!r}")
    means = average(per_query(hits, qrels, queries, k))
    return means.select(F.lit(k).alias("k"), *(F.round(m, 4).alias(m) for m in METRICS))


def at_many_k(hits: DataFrame, qrels: DataFrame, queries: DataFrame, ks=KS) -> DataFrame:
    """k and the means at each k."""
    parts = [average(per_query(hits, qrels, queries, k)).select(F.lit(k).alias("k"), *METRICS) for k in ks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def improvement(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, old, new, percent of two one-row means."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"o.{m}").alias("old"), F.col(f"n.{m}").alias("new")) for m in METRICS))
    rows = old.alias("o").join(F.broadcast(new).alias("n")).select(F.inline(pairs))
    return rows.withColumn("percent", F.round(T.percent_change(F.col("old"), F.col("new")), 4))


def ndcg_by_type(scores: DataFrame) -> DataFrame:
    kind = T.query_type(F.col("query_id"))
    return scores.groupBy(kind.alias("query_type")).agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("queries"))


def bootstrap(values: np.ndarray, resamples: int = 2000, seed: int = 0) -> tuple[float, float]:
    """The 2.5 and 97.5 % points of the means of all resamples, which are drawn at once as the rows of one matrix."""
    drawn = np.random.RandomState(seed).randint(0, len(values), (resamples, len(values)))
    low, high = np.percentile(values[drawn].mean(axis=1), (2.5, 97.5))
    return float(low), float(high)


def bootstrap_ci(scores: DataFrame, by: list[str], value: str, order: str = "query_id", resamples: int = 2000, seed: int = 0) -> DataFrame:
    """by..., mean, low, high: the percentile bootstrap of each group's mean. A group is the queries of one arm."""
    kinds = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in by)

    def run(key, rows):
        v = rows.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([(*key, v.mean(), *bootstrap(v, resamples, seed))])

    return scores.groupBy(*by).applyInPandas(run, f"{kinds}, mean double, low double, high double")
