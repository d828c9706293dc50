"""Retrieval before and after cleaning: all arms as one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnose, embed, metrics, retrieval
from .storage import without, written

MODES = ("dense", "bm25", "hybrid")


@dataclass
class Corpus:
    """An indexed namespace: documents and their vectors."""

    name: str
    docs: DataFrame
    vectors: DataFrame | None = None

    def without(self, decisions: DataFrame, name: str = "cleaned") -> Corpus:
        """The kept documents; their vectors are taken over, not made again."""
        gone = written(decisions.where("reason is not null").select("doc_id"))
        left = lambda x: None if x is None else without(x, gone)
        return Corpus(name, left(self.docs), left(self.vectors))


def index(docs: DataFrame, provider: embed.Provider | None = None, name: str = "original") -> Corpus:
    return Corpus(name, docs, written((provider or embed.provider("hashed")).embed(docs)))


def retrieve(corpus: Corpus, queries: DataFrame, mode: str = "dense", k: int = 10, candidates: int | None = None, rerank: bool = False, provider: embed.Provider | None = None) -> DataFrame:
    """Hits of queries (query_id, query). candidates: how many each list gives before fusion, reranking and the cut to k; k without reranking."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode != "bm25" and corpus.vectors is None:
        raise ValueError(f"{corpus.name} has no vectors")
    n = candidates or (50 if rerank else k)
    lists = []
    if mode != "bm25":
        asked = queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))
        made = (provider or embed.provider("hashed")).embed(asked, "query").select(F.col("doc_id").alias("query_id"), "embedding")
        lists.append(retrieval.dense_topk(corpus.vectors, made, n))
    if mode != "dense":
        lists.append(retrieval.bm25_topk(corpus.docs, queries, n))
    hits = lists[0] if len(lists) == 1 else retrieval.fuse(lists, n)
    if rerank:
        hits = _reranked(hits, corpus, queries, k)
    return hits.where(F.col("rank") <= k)


def _reranked(hits: DataFrame, corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    return retrieval.rerank(hits, queries, corpus.docs, k).select("query_id", "rank", "doc_id", "score")


def arms(corpora: list[Corpus], queries: DataFrame, qrels: DataFrame, modes=("dense", "hybrid"), k: int = 10, candidates: int = 50, provider: embed.Provider | None = None) -> DataFrame:
    """corpus, mode, rerank, query_id and the metrics of every arm, against the answers that the corpus still has."""
    out = None
    for c in corpora:
        truth = written(diagnose.present_qrels(qrels, c.docs))
        for mode in modes:
            # a single list of n hits begins with that of fewer, so both arms can share it; a fused one does not
            n = max(k, candidates)
            shared = None if mode == "hybrid" else written(retrieve(c, queries, mode, n, n, False, provider))
            for rerank in (False, True):
                if shared is None:
                    hits = retrieve(c, queries, mode, k, candidates if rerank else k, rerank, provider)
                else:
                    hits = shared.where(F.col("rank") <= (candidates if rerank else k))
                    hits = _reranked(hits, c, queries, k) if rerank else hits
                part = metrics.per_query(hits, truth, queries, k)
                part = part.select(F.lit(c.name).alias("corpus"), F.lit(mode).alias("mode"), F.lit(rerank).alias("rerank"), "query_id", *metrics.METRICS)
                out = part if out is None else out.unionAll(part)
    return out


def compare(original: Corpus, cleaned: Corpus, queries: DataFrame, qrels: DataFrame, k: int = 10, provider: embed.Provider | None = None) -> DataFrame:
    """run (original, cleaned, cleaned+rerank), query_id and the metrics against all answers, dense."""
    runs = (("original", original, False), ("cleaned", cleaned, False), ("cleaned+rerank", cleaned, True))
    out = None
    for name, c, rerank in runs:
        part = metrics.per_query(retrieve(c, queries, "dense", k, 100 if rerank else k, rerank, provider), qrels, queries, k).select(F.lit(name).alias("run"), "query_id", *metrics.METRICS)
        out = part if out is None else out.unionAll(part)
    return out
