"""The library's operators as named queries over the test tables, with DuckDB SQL for those that SQL can express.

Retrieval asks the passages of `benchmark` of `documents`; the answers are the documents that hold a passage word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import chunk, clean, dedup, diagnose, embed, metrics, quality, retrieval
from .plans import evaluate, scan
from .plans.storage import scratch, written
from .sources import csv_files, evalgen, pages, reports, vector_store


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return written(retrieval.passages_in(_docs(spark, d), _asked(spark, d)))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return clean.kept(docs, clean.decide(docs, "conservative"))


def _good(spark: SparkSession, d: str) -> DataFrame:
    """The corpus after cleaning by the quality score."""
    return clean.kept(_docs(spark, d), filter_by_quality_score(spark, d))


def _openings(spark: SparkSession, d: str) -> DataFrame:
    """The first four words of each passage as queries: too little to rank its own documents first."""
    return _asked(spark, d).withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 4), " "))


def _loose_hits(spark: SparkSession, d: str) -> DataFrame:
    return written(retrieval.bm25_topk(_docs(spark, d), _openings(spark, d), 10))


def _hits(spark: SparkSession, d: str, docs: DataFrame | None = None, k: int = 10) -> DataFrame:
    return written(retrieval.bm25_topk(_docs(spark, d) if docs is None else docs, _asked(spark, d), k))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels as classes; a document's topic is the smallest passage it holds, and it bears an answer if it is good."""
    own = spark.read.parquet(f"{d}/labels.parquet")
    topics = _qrels(spark, d).groupBy("doc_id").agg(F.min("query_id").cast("string").alias("topic_id"))
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").otherwise("good")
    return own.join(topics, "doc_id", "left").select("doc_id", kind.alias("doc_class"), F.coalesce("topic_id", F.lit("none")).alias("topic_id"), (F.col("quality") == 1).alias("answer_bearing"))


def _copy_clusters(docs: DataFrame) -> DataFrame:
    """Documents with the same normal form, as clusters."""
    return dedup.clusters(clean.exact_duplicates(docs).select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


def quick_scan(spark, d):
    return _rounded(quality.quick_scan(_docs(spark, d)))


def doc_stats(spark, d):
    return _rounded(quality.doc_stats(_docs(spark, d)).drop("repetition", "has_stop", "quality_score"))


def quality_scores(spark, d):
    return _rounded(quality.doc_stats(_docs(spark, d)).select("doc_id", "quality_score"))


def trigram_repetition(spark, d):
    return _rounded(quality.doc_stats(_docs(spark, d)).select("doc_id", "repetition"))


def quality_issues(spark, d):
    return _rounded(quality.issues(quality.doc_stats(_docs(spark, d))).drop("message", "ord"))


def issues_by_type(spark, d):
    return quality.issues_by_type(quality.issues(quality.doc_stats(_docs(spark, d))))


def length_distribution(spark, d):
    return quality.length_distribution(quality.doc_stats(_docs(spark, d)))


def length_histogram(spark, d):
    return _rounded(quality.length_histogram(quality.doc_stats(_docs(spark, d))))


def quality_bands(spark, d):
    return quality.quality_bands(quality.doc_stats(_docs(spark, d)))


def exact_duplicates(spark, d):
    return clean.exact_duplicates(_docs(spark, d))


def clean_conservative(spark, d):
    return clean.decide(_docs(spark, d), "conservative")


def clean_moderate(spark, d):
    docs = _docs(spark, d)
    return clean.decide(docs, "moderate", _copy_clusters(docs))


def clean_aggressive(spark, d):
    docs = _docs(spark, d)
    return clean.decide(docs, "aggressive", _copy_clusters(docs))


def dedup_longest(spark, d):
    docs = _docs(spark, d)
    return clean.deduplicate_only(docs, _copy_clusters(docs), "longest")


def cleanest_copy(spark, d):
    docs = _docs(spark, d)
    return clean.cleanest(docs, _copy_clusters(docs))


def filter_by_length(spark, d):
    return clean.filter_by_length(_docs(spark, d), 50, 2000)


def filter_by_quality_score(spark, d):
    docs = _docs(spark, d)
    return clean.filter_by_quality_score(docs, quality.doc_stats(docs), 0.8)


def typographic_artifacts(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.typographic_artifacts(T.text_of("html")).alias("artifacts"))


def removal_breakdown(spark, d):
    return _rounded(clean.summary(clean.decide(_docs(spark, d), "aggressive")))


def char_shingle_counts(spark, d):
    return dedup.shingle_sets(_docs(spark, d)).select("doc_id", F.size("shingles").alias("shingles"))


def jaccard_pairs(spark, d):
    return _rounded(dedup.jaccard_pairs(_docs(spark, d), 0.8))


def minhash_candidates(spark, d):
    return _rounded(dedup.minhash_candidates(_docs(spark, d)))


def two_stage_pairs(spark, d):
    docs, p = _docs(spark, d), embed.provider("hashed")
    return _rounded(dedup.two_stage_pairs(docs, written(p.embed(dedup.representatives(docs))), p.duplicate_threshold))


def cosine_pairs(spark, d):
    return _rounded(dedup.cosine_pairs(_vectors(spark, d), 0.4))


def _cosine(spark, d):
    return written(dedup.cosine_pairs(_vectors(spark, d), 0.4))


def duplicate_clusters(spark, d):
    return dedup.clusters(_cosine(spark, d))


def cluster_stats(spark, d):
    pairs = _cosine(spark, d)
    return _rounded(dedup.cluster_stats(dedup.clusters(pairs), pairs))


def duplicate_totals(spark, d):
    return _rounded(dedup.duplicate_totals(_copy_clusters(_docs(spark, d)), _docs(spark, d).count()))


def noise_scores(spark, d):
    docs = _docs(spark, d)
    return _rounded(dedup.noise_scores(docs, linked=dedup.jaccard_degrees(docs, 0.8)))


def overall_quality(spark, d):
    docs = _docs(spark, d)
    n = quality.doc_stats(docs).agg(F.count("*").alias("n"), F.avg("quality_score").alias("q"), F.sum(F.size(quality.issue_array())).alias("i"))
    dup = dedup.duplicate_totals(_copy_clusters(docs), 1).select("total_duplicates")
    return n.join(F.broadcast(dup)).select("n", "total_duplicates", quality.overall_quality(F.col("n"), F.col("total_duplicates"), F.col("q"), F.col("i")).alias("overall_quality"))


def heatmap(spark, d):
    return _rounded(dedup.heatmap(_vectors(spark, d), most=50), 5)


def dense_topk(spark, d):
    v = _vectors(spark, d)
    return retrieval.dense_topk(v, v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), 10)


def bm25_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.search_tokens(T.text_of("text"))).alias("term")).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("terms"))


def postings_stats(spark, d):
    docs = _docs(spark, d)
    return _rounded(retrieval.term_statistics(docs))


def bm25_topk(spark, d):
    return retrieval.bm25_topk(_docs(spark, d), _asked(spark, d), 10)


def rrf_hybrid(spark, d):
    """Dense and BM25 lists of the documents whose id is divisible by 100 and that have a vector, as queries against all rows."""
    v = _vectors(spark, d)
    some = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    texts = _docs(spark, d).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")).join(some.select("query_id"), "query_id")
    return retrieval.fuse([retrieval.dense_topk(v, some, 10), retrieval.bm25_topk(_docs(spark, d), texts, 10)], 10)


def hybrid_topk(spark, d):
    return evaluate.retrieve(evaluate.index(_docs(spark, d)), _asked(spark, d), "hybrid", 10)


def rerank(spark, d):
    return retrieval.rerank(_hits(spark, d, k=20), _asked(spark, d), _docs(spark, d), 5)


def qrels(spark, d):
    return retrieval.passages_in(_docs(spark, d), _asked(spark, d))


def query_metrics(spark, d):
    return metrics.per_query(_hits(spark, d), _qrels(spark, d), _asked(spark, d))


def mean_metrics(spark, d):
    return metrics.average(query_metrics(spark, d))


def metrics_summary(spark, d):
    return metrics.summary(_hits(spark, d), _qrels(spark, d), _asked(spark, d), 10)


def metrics_multi_k(spark, d):
    return metrics.at_many_k(_hits(spark, d, k=20), _qrels(spark, d), _asked(spark, d))


def _two_runs(spark, d):
    answers, asked = _qrels(spark, d), _asked(spark, d)
    left = _cleaned(spark, d)
    return metrics.per_query(_hits(spark, d), answers, asked), metrics.per_query(_hits(spark, d, left), answers, asked)


def compare_runs(spark, d):
    a, b = _two_runs(spark, d)
    names = metrics.METRICS
    return a.select("query_id", *(F.col(m).alias(f"{m}_old") for m in names)).join(b.select("query_id", *(F.col(m).alias(f"{m}_new") for m in names)), "query_id")


def improvement(spark, d):
    a, b = _two_runs(spark, d)
    return metrics.improvement(metrics.average(a), metrics.average(b))


def ndcg_by_type(spark, d):
    named = lambda df: df.withColumn("query_id", F.concat(F.when(F.col("query_id") % 2 == 0, "qc_").otherwise("q_"), F.col("query_id")))
    return metrics.ndcg_by_type(metrics.per_query(named(_hits(spark, d)), named(_qrels(spark, d)), named(_asked(spark, d))))


def bootstrap_ci(spark, d):
    return _rounded(metrics.bootstrap_ci(query_metrics(spark, d).withColumn("arm", F.lit("bm25")), ["arm"], "ndcg"))


def present_qrels(spark, d):
    return diagnose.present_qrels(_qrels(spark, d), _cleaned(spark, d))


def answers_destroyed(spark, d):
    return diagnose.answers_destroyed(_qrels(spark, d), _good(spark, d))


def distractors(spark, d):
    return diagnose.distractors(diagnose.displacements(_loose_hits(spark, d), _qrels(spark, d))).select("doc_id", "displacements", F.array_join(F.transform("queries", lambda x: x.cast("string")), ",").alias("queries"))


def top_distractors(spark, d):
    return diagnose.distractors(diagnose.displacements(_loose_hits(spark, d), _qrels(spark, d)), 5).select("doc_id", "displacements")


def failure_classes(spark, d):
    left = _good(spark, d)
    hits = written(retrieval.bm25_topk(left, _openings(spark, d), 10))
    return diagnose.failure_classes(hits, _qrels(spark, d), left, _asked(spark, d))


def fact_recall(spark, d):
    return diagnose.fact_recall(_hits(spark, d), _qrels(spark, d), _labels(spark, d))


def removed_by_class(spark, d):
    return diagnose.removed_by_class(clean.decide(_docs(spark, d), "aggressive"), _labels(spark, d))


def cleaning_attribution(spark, d):
    """The labels say exact_dup of later documents with the same raw text; cleaning goes by the normal form."""
    docs = _docs(spark, d)
    same = dedup.members(docs)
    kind = F.when(F.col("doc_id") != F.col("rep"), "exact_dup").otherwise("good")
    return diagnose.cleaning_attribution(docs, clean.decide(docs, "conservative"), same.select("doc_id", kind.alias("doc_class")))


def chunk_sentence(spark, d):
    return chunk.chunk(_docs(spark, d), "sentence")


def chunk_fixed(spark, d):
    return chunk.chunk(_docs(spark, d), "fixed")


def chunk_paragraph(spark, d):
    return chunk.chunk(_docs(spark, d), "paragraph")


def chunk_estimate(spark, d):
    return chunk.estimate(_docs(spark, d))


def distractor_classes(spark, d):
    return diagnose.distractor_classes(diagnose.distractors(diagnose.displacements(_loose_hits(spark, d), _qrels(spark, d))), _labels(spark, d))


def class_counts(spark, d):
    return diagnose.class_counts(_labels(spark, d))


def removed_documents(spark, d):
    """What aggressive cleaning removes, through the CSV file that a user would download."""
    docs = _docs(spark, d)
    path = scratch(spark)
    reports.removed_csv(docs, clean.decide(docs, "aggressive"), path)
    return csv_files.read(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "reason")


def removal_percentages(spark, d):
    docs = _docs(spark, d)
    return _rounded(reports.percentages(quality.doc_stats(docs), clean.decide(docs, "aggressive")))


def csv_documents(spark, d):
    """The documents, written as CSV and loaded again."""
    path = scratch(spark)
    csv_files.write(spark.read.parquet(f"{d}/documents.parquet"), path)
    back = csv_files.documents(spark, path, "text", "doc_id", ["lang", "source"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length("text").alias("chars"), F.md5("text").alias("md5"), F.col("metadata")["lang"].alias("lang"))


def csv_ground_truth(spark, d):
    """The answers, written as a ground-truth CSV and loaded again."""
    path = scratch(spark)
    lists = _qrels(spark, d).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ", ").alias("relevant_doc_ids"))
    csv_files.write(_asked(spark, d).join(lists, "query_id", "left"), path)
    _, truth = csv_files.ground_truth(spark, path, id_column="query_id")
    return truth.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"))


def page_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", pages.clean_page(T.text_of("html")).alias("text"))


def upload_union(spark, d):
    """Web pages as the pages of files and documents as CSV rows, in one table: long pages are cut into sentences."""
    paged = spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("page_"), "page_id").alias("doc_id"), F.lit("web").alias("source"), T.text_of("html").alias("text"))
    rows = _docs(spark, d).select(F.concat(F.lit("row_"), "doc_id").alias("doc_id"), F.lit("csv").alias("source"), T.text_of("text").alias("text"))
    made = pages.upload([paged], [rows])
    return made.groupBy("source").agg(F.count("*").alias("rows"), F.max(F.char_length("text")).alias("longest"))


def vector_upsert(spark, d):
    """All vectors, then every third one again with another tag: one row for each id, the later tag."""
    store = vector_store.VectorStore(spark, scratch(spark))
    rows = _vectors(spark, d)
    store.create_index(rows.select(F.size("embedding")).first()[0])
    store.upsert(rows.withColumn("tag", F.lit("first")))
    store.upsert(rows.where("doc_id % 3 = 0").withColumn("tag", F.lit("second")))
    return store.rows().select("doc_id", "tag")


def unit_vectors(spark, d):
    return _vectors(spark, d).select("doc_id", F.round(F.aggregate(V.normalise(F.col("embedding")), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("square"))


def query_prefix(spark, d):
    return _asked(spark, d).select("query_id", T.with_prefix(F.col("query"), "query", "multilingual-e5").alias("text"))


def scan_summary(spark, d):
    return _rounded(scan.scan(_docs(spark, d), method="jaccard", threshold=0.8).summary())


def scan_issues(spark, d):
    return scan.scan(_docs(spark, d), method="jaccard", threshold=0.8).issues_breakdown()


def scan_and_clean(spark, d):
    return scan.scan(_docs(spark, d), method="jaccard", threshold=0.8).clean("moderate")


def dedup_first(spark, d):
    docs = _docs(spark, d)
    return clean.deduplicate_only(docs, _copy_clusters(docs), "first")


def ablation_bm25(spark, d):
    """The arms of the original and the conservatively cleaned corpus, BM25 with and without reranking."""
    docs, asked = _docs(spark, d), _asked(spark, d)
    corpora = [evaluate.Corpus("original", docs), evaluate.Corpus("cleaned", _cleaned(spark, d))]
    return evaluate.arms(corpora, asked, _qrels(spark, d), modes=("bm25",), candidates=20)


def compare_corpora(spark, d):
    docs = _docs(spark, d)
    whole = evaluate.index(docs)
    return evaluate.compare(whole, whole.without(clean.decide(docs, "conservative")), _asked(spark, d), _qrels(spark, d))


def generated_classes(spark, d):
    """The classes of the seeded evaluation set, whose sizes are its parameters."""
    return diagnose.class_counts(evalgen.generate().frames(spark)[3])


QUERIES = {
    f.__name__: f
    for f in (
        quick_scan, doc_stats, quality_scores, trigram_repetition, quality_issues, issues_by_type, length_distribution, length_histogram, quality_bands,
        exact_duplicates, clean_conservative, clean_moderate, clean_aggressive, dedup_longest, cleanest_copy, filter_by_length, filter_by_quality_score,
        typographic_artifacts, removal_breakdown, char_shingle_counts, jaccard_pairs, minhash_candidates, two_stage_pairs, cosine_pairs, duplicate_clusters,
        cluster_stats, duplicate_totals, noise_scores, overall_quality, heatmap, dense_topk, bm25_tokens, postings_stats, bm25_topk, rrf_hybrid, hybrid_topk,
        rerank, qrels, query_metrics, mean_metrics, metrics_summary, metrics_multi_k, compare_runs, improvement, ndcg_by_type, bootstrap_ci, present_qrels, answers_destroyed,
        distractors, top_distractors, failure_classes, fact_recall, removed_by_class, cleaning_attribution, chunk_sentence, chunk_fixed, chunk_paragraph, chunk_estimate,
        distractor_classes, class_counts, removed_documents, removal_percentages, csv_documents, csv_ground_truth, page_text, upload_union, vector_upsert, unit_vectors,
        query_prefix, scan_summary, scan_issues, scan_and_clean, dedup_first, ablation_bm25, compare_corpora, generated_classes,
    )
}
