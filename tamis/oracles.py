"""DuckDB SQL for the queries of queries.py, written from the definitions; doubles are rounded as the queries round them."""

from __future__ import annotations

_STATS = r"""
words AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
stats AS (
  SELECT doc_id, t, length(t) AS char_count, len(ws) AS word_count,
    len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS sentence_count,
    CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE / len(ws) ELSE 0 END AS avg_word_length,
    CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[^\p{L}\p{N}_\s.,!?;:''"\-]'))::DOUBLE / length(t) ELSE 0 END AS special_char_ratio,
    CASE WHEN len(ws) >= 15 THEN 1 - len(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))))::DOUBLE / (len(ws) - 2) END AS repetition
  FROM words),
scored AS (
  SELECT *, least(1.0, (CASE WHEN char_count < 10 THEN 0.3 WHEN char_count > 2000 THEN 0.7 ELSE 1.0 END)::DOUBLE * (CASE WHEN word_count < 3 THEN 0.4 ELSE 1.0 END)::DOUBLE
    * (CASE WHEN special_char_ratio > 0.1 THEN 0.5 ELSE 1.0 END)::DOUBLE
    * (CASE WHEN sentence_count > 0 AND word_count > 0 AND word_count::DOUBLE / nullif(sentence_count, 0) BETWEEN 5 AND 25 THEN 1.1 ELSE 1.0 END)::DOUBLE) AS quality_score
  FROM stats),
issues AS (
  SELECT doc_id, 0 AS ord, 'too_short' AS issue_type, 'error' AS severity, char_count::DOUBLE AS value FROM scored WHERE char_count < 10
  UNION ALL SELECT doc_id, 1, 'too_long', 'warning', char_count FROM scored WHERE char_count > 2000
  UNION ALL SELECT doc_id, 2, 'low_word_count', 'error', word_count FROM scored WHERE word_count < 3
  UNION ALL SELECT doc_id, 3, 'high_special_char_ratio', 'warning', special_char_ratio FROM scored WHERE special_char_ratio > 0.1
  UNION ALL SELECT doc_id, 4, 'missing_punctuation', 'warning', word_count FROM scored WHERE word_count >= 20 AND sentence_count <= 1 AND NOT regexp_matches(t, '[.!?]')
  UNION ALL SELECT doc_id, 5, 'repetitive_content', 'warning', repetition FROM scored WHERE repetition > 0.5)"""

_FORMS = r"""
forms AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS form, length(coalesce(text, '')) AS n FROM documents),
firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY form) AS first_id, count(*) OVER (PARTITION BY form) AS copies FROM forms)"""

_CLUSTERS = "clusters AS (SELECT doc_id, n, dense_rank() OVER (ORDER BY first_id) - 1 AS cluster_id, first_id FROM firsts WHERE copies > 1)"

#: The typographic artifacts of documents are counted as well, though the test table has none.
_KEEP = r"keep AS (SELECT cluster_id, arg_min(c.doc_id, (len(regexp_extract_all(d.text, '\s{2,}')) + len(regexp_extract_all(d.text, '\s[.!?,]')), c.n, c.doc_id)) AS keep_id FROM clusters c JOIN documents d USING (doc_id) GROUP BY cluster_id)"

_TOKENS = "tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zA-Z가-힣]+')) AS term FROM {docs})"


def _bm25(docs: str = "documents", k: int = 10, name: str = "hits", asked: str = "benchmark") -> str:
    """Hits of the passages over the table docs, zero scores included. The test tables have no Hangul, so no 2-grams."""
    p = f"{name}_"
    return f"""
{p}tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zA-Z가-힣]+')) AS term FROM {docs}),
{p}tf AS (SELECT doc_id, term, count(*) AS tf FROM {p}tok GROUP BY ALL),
{p}len AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zA-Z가-힣]+')) AS dl FROM {docs}),
{p}raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM {docs}) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {p}tf GROUP BY term),
{p}idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}raw) ELSE raw END AS idf FROM {p}raw),
{p}q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[0-9a-zA-Z가-힣]+')) AS term FROM {asked}),
{p}sum AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM {p}len)))) AS score
  FROM {p}q JOIN {p}tf USING (term) JOIN {p}idf USING (term) JOIN {p}len USING (doc_id) GROUP BY ALL),
{p}all AS (SELECT b.item_id AS query_id, d.doc_id, round(coalesce(s.score, 0), 6) AS score FROM {asked} b CROSS JOIN {docs} d LEFT JOIN {p}sum s ON s.query_id = b.item_id AND s.doc_id = d.doc_id),
{name} AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {p}all) WHERE rank <= {k})"""


_OPENINGS = "openings AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS text FROM benchmark)"
_QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _scores(hits: str = "hits", k: int = 10, name: str = "scores", query: str = "query_id") -> str:
    return f"""
{name}_m AS (SELECT h.query_id, h.rank, (r.doc_id IS NOT NULL)::INT AS rel FROM {hits} h LEFT JOIN qrels r ON r.query_id = h.query_id AND r.doc_id = h.doc_id WHERE rank <= {k}),
{name}_g AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(rel) AS found, count(*) AS n, min(rank) FILTER (rel = 1) AS first FROM {name}_m GROUP BY query_id),
{name}_a AS (SELECT query_id, count(*) AS answers, list_sum(list_transform(range(1, least(count(*), {k}) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM qrels GROUP BY query_id),
{name} AS (SELECT b.item_id AS query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(CASE WHEN answers IS NOT NULL AND found > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS hit_rate,
  round(CASE WHEN answers IS NOT NULL THEN coalesce(1.0::DOUBLE / first, 0) ELSE 0 END, 6) AS mrr, round(CASE WHEN answers IS NOT NULL THEN coalesce(found::DOUBLE / n, 0) ELSE 0 END, 6) AS precision,
  round(coalesce(found::DOUBLE / answers, 0), 6) AS recall
  FROM benchmark b LEFT JOIN {name}_g g ON g.query_id = b.item_id LEFT JOIN {name}_a a ON a.query_id = b.item_id)"""


_MEANS = "round(coalesce(avg(ndcg), 0), 6) AS ndcg, round(coalesce(avg(hit_rate), 0), 6) AS hit_rate, round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(precision), 0), 6) AS precision, round(coalesce(avg(recall), 0), 6) AS recall"
_KEPT = f"{_FORMS}, kept AS (SELECT d.* FROM documents d JOIN firsts f USING (doc_id) WHERE f.doc_id = f.first_id)"
_DISPLACED = """
marked AS (SELECT h.query_id, h.rank, h.doc_id, r.doc_id IS NOT NULL AS rel FROM hits h JOIN (SELECT DISTINCT query_id FROM qrels) USING (query_id) LEFT JOIN qrels r ON r.query_id = h.query_id AND r.doc_id = h.doc_id),
displaced AS (SELECT query_id, doc_id FROM (SELECT *, min(rank) FILTER (rel) OVER (PARTITION BY query_id) AS first FROM marked) WHERE NOT rel AND (first IS NULL OR rank < first))"""
_LABELS = """classes AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' ELSE 'good' END AS doc_class, coalesce(t.topic_id, 'none') AS topic_id, quality = 1 AS answer_bearing
  FROM labels l LEFT JOIN (SELECT doc_id, min(query_id)::VARCHAR AS topic_id FROM qrels GROUP BY doc_id) t USING (doc_id))"""
_AGGRESSIVE = """reasons AS (SELECT s.doc_id, (SELECT arg_min(issue_type, ord) FROM issues i WHERE i.doc_id = s.doc_id AND issue_type IN ('too_short', 'low_word_count', 'high_special_char_ratio')) AS reason FROM scored s)"""
_COSINE = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.4)"""
_REACH = """ends AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON e.a = r.seen),
found AS (SELECT node AS doc_id, dense_rank() OVER (ORDER BY min(seen)) - 1 AS cluster_id FROM reach GROUP BY node)"""
_SHINGLES = r"""
texts AS (SELECT trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS s, rep, n FROM (SELECT coalesce(text, '') AS t, min(doc_id) AS rep, count(*) AS n FROM documents GROUP BY 1)),
sh AS (SELECT DISTINCT rep, unnest(CASE WHEN length(s) >= 4 THEN list_transform(range(1, length(s) - 2), lambda i: s[i:i + 3]) WHEN length(s) > 0 THEN [s] ELSE [] END) AS g FROM texts),
size AS (SELECT rep, count(*) AS m FROM sh GROUP BY rep),
common AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
pairs AS (SELECT a, b, c::DOUBLE / (p.m + q.m - c) AS score FROM common JOIN size p ON p.rep = a JOIN size q ON q.rep = b WHERE c::DOUBLE / (p.m + q.m - c) >= 0.8)"""

#: Clusters over representatives of equal texts: linked ones, and those of several copies; members are all documents of them.
_REACH_REP = """ends AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT rep, rep FROM texts WHERE n > 1),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON e.a = r.seen),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
members AS (SELECT o.doc_id, root FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS rep FROM documents) o JOIN roots ON roots.node = o.rep)"""


def _recommend(total: str, issues: str, quality: str) -> str:
    return f"""CASE WHEN {total} = 0 THEN NULL WHEN {issues} = 0 AND {quality} >= 0.8 THEN 'good: look for duplicates next' WHEN {issues}::DOUBLE / nullif({total}, 0) > 0.2 THEN 'many issues: clean aggressively'
  WHEN {quality} < 0.5 THEN 'low quality: review short documents and special characters' ELSE 'some issues: clean moderately' END"""


def _multi_k() -> str:
    parts = ", ".join(_scores(k=k, name=f"s{k}") for k in (1, 3, 5, 10, 20))
    rows = " UNION ALL ".join(f"SELECT {k} AS k, {_MEANS} FROM s{k}" for k in (1, 3, 5, 10, 20))
    return f"WITH {_bm25(k=20)}, {_QRELS}, {parts} {rows}"


_TWO = f"WITH {_KEPT}, {_bm25()}, {_bm25('kept', name='after')}, {_QRELS}, {_scores()}, {_scores('after', name='later')}"
_BINS = ("0-50", 0, 50), ("50-200", 50, 200), ("200-500", 200, 500), ("500-1000", 500, 1000), ("1000+", 1000, 10**12)
_LOW = "(SELECT min(char_count) FROM stats)"
_WIDTH = f"((SELECT max(char_count) FROM stats) - {_LOW})::DOUBLE"

SQL = {
    "quick_scan": f"""WITH {_STATS}, a AS (SELECT count(*) AS n, avg(quality_score) AS q FROM scored), b AS (SELECT count(*) AS i, count(DISTINCT doc_id) AS d FROM issues)
SELECT n AS total_documents, round(coalesce(q, 0), 6) AS avg_quality_score, i AS total_issues, d AS documents_with_issues, {_recommend('n', 'i', 'q')} AS recommendation FROM a, b""",
    "doc_stats": f"WITH {_STATS} SELECT doc_id, char_count, word_count, sentence_count, round(avg_word_length, 6) AS avg_word_length, round(special_char_ratio, 6) AS special_char_ratio FROM stats",
    "quality_scores": f"WITH {_STATS} SELECT doc_id, round(quality_score, 6) AS quality_score FROM scored",
    "trigram_repetition": f"WITH {_STATS} SELECT doc_id, round(repetition, 6) AS repetition FROM stats",
    "quality_issues": f"WITH {_STATS} SELECT doc_id, issue_type, severity, round(value, 6) AS value FROM issues",
    "issues_by_type": f"WITH {_STATS} SELECT issue_type, count(*) AS n FROM issues GROUP BY issue_type",
    "length_distribution": f"WITH {_STATS} " + " UNION ALL ".join(f"SELECT '{b}' AS bin, count(*) AS n FROM stats WHERE char_count >= {lo} AND char_count < {hi}" for b, lo, hi in _BINS),
    "length_histogram": f"""WITH {_STATS}, bins AS (SELECT unnest(range(20)) AS bin), hits AS (SELECT least(19, floor((char_count - {_LOW}) / {_WIDTH} * 20))::INT AS bin, count(*) AS n FROM stats GROUP BY 1)
SELECT bin, round({_LOW} + bin * ({_WIDTH} / 20), 6) AS low, round({_LOW} + (bin + 1) * ({_WIDTH} / 20), 6) AS high, coalesce(n, 0) AS n FROM bins LEFT JOIN hits USING (bin)""",
    "quality_bands": f"WITH {_STATS} SELECT 'low' AS band, count(*) FILTER (quality_score < 0.5) AS n FROM scored UNION ALL SELECT 'medium', count(*) FILTER (quality_score >= 0.5 AND quality_score < 0.8) FROM scored UNION ALL SELECT 'high', count(*) FILTER (quality_score >= 0.8) FROM scored",
    "exact_duplicates": f"WITH {_FORMS} SELECT doc_id, first_id FROM firsts WHERE doc_id <> first_id",
    "clean_conservative": f"WITH {_FORMS} SELECT doc_id, CASE WHEN doc_id <> first_id THEN 'exact_duplicate' END AS reason FROM firsts",
    "clean_moderate": f"""WITH {_FORMS}, {_CLUSTERS}, {_KEEP} SELECT f.doc_id, CASE WHEN k.keep_id <> f.doc_id THEN 'duplicate' WHEN f.n < 10 THEN 'too_short' END AS reason
FROM firsts f LEFT JOIN clusters c USING (doc_id) LEFT JOIN keep k USING (cluster_id)""",
    "clean_aggressive": f"""WITH {_FORMS}, {_CLUSTERS}, {_KEEP}, {_STATS}, {_AGGRESSIVE} SELECT f.doc_id, CASE WHEN k.keep_id <> f.doc_id THEN 'duplicate' ELSE r.reason END AS reason
FROM firsts f JOIN reasons r USING (doc_id) LEFT JOIN clusters c USING (doc_id) LEFT JOIN keep k USING (cluster_id)""",
    "dedup_longest": f"""WITH {_FORMS}, {_CLUSTERS}, best AS (SELECT cluster_id, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM clusters GROUP BY cluster_id)
SELECT f.doc_id, CASE WHEN b.keep_id <> f.doc_id THEN 'duplicate' END AS reason FROM firsts f LEFT JOIN clusters c USING (doc_id) LEFT JOIN best b USING (cluster_id)""",
    "cleanest_copy": f"WITH {_FORMS}, {_CLUSTERS}, {_KEEP} SELECT cluster_id, keep_id FROM keep",
    "filter_by_length": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 50 THEN 'too_short' WHEN length(text) > 2000 THEN 'too_long' END AS reason FROM documents",
    "filter_by_quality_score": f"WITH {_STATS} SELECT doc_id, CASE WHEN quality_score < 0.8 THEN 'low_quality' END AS reason FROM scored",
    "typographic_artifacts": r"SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '\s{2,}')) + len(regexp_extract_all(coalesce(html, ''), '\s[.!?,]')) AS artifacts FROM pages",
    "removal_breakdown": f"WITH {_STATS}, {_AGGRESSIVE} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent FROM reasons GROUP BY 1",
    "char_shingle_counts": r"""WITH s AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) >= 4 THEN len(list_distinct(list_transform(range(1, length(s) - 2), lambda i: s[i:i + 3]))) WHEN length(s) > 0 THEN 1 ELSE 0 END AS shingles FROM s""",
    "jaccard_pairs": f"WITH {_SHINGLES} SELECT a, b, round(score, 6) AS score FROM pairs",
    "cosine_pairs": f"WITH {_COSINE} SELECT a, b, round(score, 6) AS score FROM pairs",
    "duplicate_clusters": f"WITH RECURSIVE {_COSINE}, {_REACH} SELECT doc_id, cluster_id FROM found",
    "cluster_stats": f"""WITH RECURSIVE {_COSINE}, {_REACH}, sized AS (SELECT cluster_id, count(*) AS size, min(doc_id) AS representative_id FROM found GROUP BY 1)
SELECT s.*, round((SELECT avg(score) FROM pairs p JOIN found f ON f.doc_id = p.a WHERE f.cluster_id = s.cluster_id), 6) AS avg_similarity FROM sized s""",
    "duplicate_totals": f"""WITH {_FORMS}, {_CLUSTERS} SELECT count(*) AS total_duplicates, count(*) - count(DISTINCT cluster_id) AS unique_duplicates, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS duplicate_percentage FROM clusters""",
    "noise_scores": f"""WITH {_SHINGLES}, ends AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), linked AS (SELECT a AS rep, sum(t.n) AS l FROM ends JOIN texts t ON t.rep = ends.b GROUP BY a),
own AS (SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY coalesce(text, '')) AS rep, count(*) OVER (PARTITION BY coalesce(text, '')) AS n FROM documents d)
SELECT doc_id, (n - 1 + coalesce(l, 0))::BIGINT AS degree, round((n - 1 + coalesce(l, 0)) / ((SELECT count(*) FROM documents) - 1)::DOUBLE, 6) AS noise_score FROM own LEFT JOIN linked USING (rep)""",
    "overall_quality": f"""WITH {_FORMS}, {_STATS}, a AS (SELECT count(*) AS n, avg(quality_score) AS q, (SELECT count(*) FROM issues) AS i, (SELECT count(*) FROM firsts WHERE copies > 1) AS m FROM scored)
SELECT n, m AS total_duplicates, round(0.4::DOUBLE * greatest(0, 1 - 2 * m::DOUBLE / n) + 0.4::DOUBLE * q + 0.2::DOUBLE * greatest(0, 1 - i::DOUBLE / n), 3) AS overall_quality FROM a""",
    "dense_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q CROSS JOIN v d WHERE q.id % 100 = 0)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "bm25_tokens": f"WITH {_TOKENS.format(docs='documents')} SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM tokens GROUP BY doc_id",
    "postings_stats": f"WITH {_bm25()} SELECT term, df, round(idf, 6) AS idf FROM hits_idf",
    "bm25_topk": f"WITH {_bm25()} SELECT query_id, rank, doc_id, score FROM hits",
    "rrf_hybrid": f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), asked AS (SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT id FROM v)), {_bm25(asked='asked')},
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q CROSS JOIN v d WHERE q.id % 100 = 0),
dense AS (SELECT query_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10),
every AS (SELECT query_id, doc_id, 0 AS list, rank FROM dense UNION ALL SELECT query_id, doc_id, 1, rank FROM hits),
fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min((list, rank)) AS seen FROM every GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM fused) WHERE rank <= 10""",
    "rerank": f"""WITH {_bm25(k=20)}, q AS (SELECT DISTINCT query_id, term FROM hits_q), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
c AS (SELECT h.query_id, h.doc_id, h.rank AS old, h.score AS original_score, round(count(t.term)::DOUBLE / any_value(n.n), 6) AS rerank_score
  FROM hits h JOIN n USING (query_id) JOIN q ON q.query_id = h.query_id LEFT JOIN hits_tf t ON t.doc_id = h.doc_id AND t.term = q.term GROUP BY ALL)
SELECT query_id, rank, doc_id, rerank_score AS score, original_score, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM c) WHERE rank <= 5""",
    "qrels": f"WITH {_QRELS} SELECT * FROM qrels",
    "query_metrics": f"WITH {_bm25()}, {_QRELS}, {_scores()} SELECT * FROM scores",
    "mean_metrics": f"WITH {_bm25()}, {_QRELS}, {_scores()} SELECT {_MEANS} FROM scores",
    "metrics_summary": f"WITH {_bm25()}, {_QRELS}, {_scores()}, m AS (SELECT {_MEANS} FROM scores) SELECT 10 AS k, round(ndcg, 4) AS ndcg, round(hit_rate, 4) AS hit_rate, round(mrr, 4) AS mrr, round(precision, 4) AS precision, round(recall, 4) AS recall FROM m",
    "metrics_multi_k": _multi_k(),
    "compare_runs": f"{_TWO} SELECT s.query_id, " + ", ".join(f"s.{m} AS {m}_old, l.{m} AS {m}_new" for m in ("ndcg", "hit_rate", "mrr", "precision", "recall")) + " FROM scores s JOIN later l USING (query_id)",
    "improvement": f"{_TWO}, o AS (SELECT {_MEANS} FROM scores), n AS (SELECT {_MEANS} FROM later), rows AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, o.{m} AS old, n.{m} AS new FROM o, n" for m in ("ndcg", "hit_rate", "mrr", "precision", "recall"))
    + ") SELECT metric, old, new, round(CASE WHEN old = 0 THEN CASE WHEN new > 0 THEN 100.0 ELSE 0.0 END ELSE (new - old) / old * 100 END, 4) AS percent FROM rows",
    "ndcg_by_type": f"WITH {_bm25()}, {_QRELS}, {_scores()} SELECT CASE WHEN query_id % 2 = 0 THEN 'code' ELSE 'attribute' END AS query_type, round(avg(ndcg), 6) AS ndcg, count(*) AS queries FROM scores GROUP BY 1",
    "present_qrels": f"WITH {_KEPT}, {_QRELS} SELECT query_id, doc_id FROM qrels SEMI JOIN kept USING (doc_id)",
    "answers_destroyed": f"WITH {_STATS}, {_QRELS} SELECT query_id, count(*) AS answers, count(*) FILTER (quality_score >= 0.8) AS present FROM qrels JOIN scored USING (doc_id) GROUP BY query_id HAVING present = 0",
    "distractors": f"WITH {_OPENINGS}, {_bm25(asked='openings')}, {_QRELS}, {_DISPLACED} SELECT doc_id, count(*) AS displacements, string_agg(query_id::VARCHAR, ',' ORDER BY query_id) AS queries FROM displaced GROUP BY doc_id",
    "top_distractors": f"WITH {_OPENINGS}, {_bm25(asked='openings')}, {_QRELS}, {_DISPLACED} SELECT doc_id, count(*) AS displacements FROM displaced GROUP BY doc_id ORDER BY displacements DESC, doc_id LIMIT 5",
    "failure_classes": f"""WITH {_STATS}, short AS (SELECT d.* FROM documents d JOIN scored USING (doc_id) WHERE quality_score >= 0.8), {_OPENINGS}, {_bm25('short', asked='openings')}, {_QRELS}, present AS (SELECT q.* FROM qrels q SEMI JOIN short s USING (doc_id))
SELECT item_id AS query_id, CASE WHEN item_id NOT IN (SELECT query_id FROM present) THEN 'fp1_missing_content' WHEN item_id NOT IN (SELECT p.query_id FROM present p JOIN hits h ON h.query_id = p.query_id AND h.doc_id = p.doc_id) THEN 'fp2_missed_top_ranked' ELSE 'ok' END AS outcome FROM benchmark""",
    "fact_recall": f"""WITH {_bm25()}, {_QRELS}, {_LABELS}, wanted AS (SELECT DISTINCT query_id, topic_id FROM qrels JOIN classes USING (doc_id) WHERE topic_id <> 'none'),
had AS (SELECT DISTINCT query_id, topic_id FROM hits JOIN classes USING (doc_id) WHERE answer_bearing)
SELECT w.query_id, count(*) AS facts, count(h.topic_id) AS covered, round(count(h.topic_id)::DOUBLE / count(*), 6) AS fact_recall FROM wanted w LEFT JOIN had h ON h.query_id = w.query_id AND h.topic_id = w.topic_id GROUP BY w.query_id""",
    "removed_by_class": f"WITH {_QRELS}, {_LABELS}, {_STATS}, {_AGGRESSIVE} SELECT coalesce(doc_class, 'unknown') AS doc_class, count(*) AS removed FROM reasons LEFT JOIN classes USING (doc_id) WHERE reason IS NOT NULL GROUP BY 1",
    "cleaning_attribution": f"""WITH {_FORMS}, dup AS (SELECT doc_id FROM documents QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, ''))), gone AS (SELECT doc_id, form FROM firsts WHERE doc_id <> first_id), kept AS (SELECT form FROM firsts WHERE doc_id = first_id)
SELECT count(*) AS dup_removed, count(*) FILTER (doc_id IN (SELECT doc_id FROM dup) OR form IN (SELECT form FROM kept)) AS "right", count(*) FILTER (doc_id IN (SELECT doc_id FROM dup)) AS found, (SELECT count(*) FROM dup) AS true_dups,
round(count(*) FILTER (doc_id IN (SELECT doc_id FROM dup) OR form IN (SELECT form FROM kept))::DOUBLE / nullif(count(*), 0), 6) AS dedup_precision,
round(count(*) FILTER (doc_id IN (SELECT doc_id FROM dup))::DOUBLE / nullif((SELECT count(*) FROM dup), 0), 6) AS dedup_recall FROM gone""",
    "distractor_classes": f"""WITH {_OPENINGS}, {_bm25(asked='openings')}, {_QRELS}, {_DISPLACED}, {_LABELS} SELECT doc_id, n AS displacements, coalesce(doc_class, 'unknown') AS doc_class
FROM (SELECT doc_id, count(*) AS n FROM displaced GROUP BY doc_id) LEFT JOIN classes USING (doc_id)""",
    "class_counts": f"WITH {_QRELS}, {_LABELS} SELECT doc_class, count(*) AS n FROM classes GROUP BY 1",
    "removed_documents": f"WITH {_STATS}, {_AGGRESSIVE} SELECT doc_id, substring(t, 1, 100) AS text, reason FROM reasons JOIN scored USING (doc_id) WHERE reason IS NOT NULL",
    "removal_percentages": f"""WITH {_STATS}, {_AGGRESSIVE} SELECT count(*) AS documents, round(count(*) FILTER (reason IS NULL) * 100.0 / count(*), 6) AS retained_percent,
round((SELECT count(DISTINCT doc_id) FROM issues) * 100.0 / count(*), 6) AS issue_percent FROM reasons""",
    "csv_documents": r"""WITH t AS (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)
SELECT doc_id, length(s) AS chars, md5(s) AS md5, lang FROM t WHERE s <> '' AND lower(s) <> 'nan'""",
    "csv_ground_truth": f"WITH {_QRELS} SELECT query_id, doc_id FROM qrels",
    "page_text": r"""SELECT page_id, regexp_replace(array_to_string(list_filter(list_transform(string_split(coalesce(html, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' '), ' +', ' ', 'g') AS text FROM pages""",
    "vector_upsert": "SELECT vec_id AS doc_id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS tag FROM embeddings",
    "unit_vectors": "SELECT vec_id AS doc_id, CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS square FROM embeddings",
    "query_prefix": "SELECT item_id AS query_id, 'query: ' || text AS text FROM benchmark",
    "scan_summary": f"""WITH RECURSIVE {_SHINGLES}, {_REACH_REP}, {_STATS}, a AS (SELECT count(*) AS n, avg(quality_score) AS q, (SELECT count(*) FROM issues) AS i FROM scored),
b AS (SELECT count(DISTINCT root) AS c, count(*) AS m FROM members)
SELECT n AS total_documents, round(q, 6) AS avg_quality_score, i AS total_issues, c AS clusters, m AS total_duplicates, m - c AS unique_duplicates,
round(0.4::DOUBLE * greatest(0, 1 - 2 * m::DOUBLE / n) + 0.4::DOUBLE * q + 0.2::DOUBLE * greatest(0, 1 - i::DOUBLE / n), 3) AS overall_quality, {_recommend('n', 'i', 'q')} AS recommendation FROM a, b""",
    "scan_issues": f"""WITH RECURSIVE {_SHINGLES}, {_REACH_REP}, {_STATS} SELECT issue_type, count(*) AS n FROM issues GROUP BY 1
UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT root) FROM members""",
    "scan_and_clean": rf"""WITH RECURSIVE {_SHINGLES}, {_REACH_REP},
facts AS (SELECT doc_id, length(coalesce(text, '')) AS n, len(regexp_extract_all(coalesce(text, ''), '\s{{2,}}')) + len(regexp_extract_all(coalesce(text, ''), '\s[.!?,]')) AS a FROM documents),
best AS (SELECT root, arg_min(doc_id, (a, f.n, doc_id)) AS keep_id FROM members JOIN facts f USING (doc_id) GROUP BY root)
SELECT f.doc_id, CASE WHEN keep_id <> f.doc_id THEN 'duplicate' WHEN f.n < 10 THEN 'too_short' END AS reason FROM facts f LEFT JOIN members m USING (doc_id) LEFT JOIN best USING (root)""",
    "dedup_first": f"WITH {_FORMS} SELECT doc_id, CASE WHEN doc_id <> first_id THEN 'duplicate' END AS reason FROM firsts",
    "generated_classes": "SELECT * FROM (VALUES ('gold', 40::BIGINT), ('relevant', 40), ('related', 80), ('irrelevant', 20), ('exact_dup', 15), ('near_dup', 15), ('low_quality', 12)) AS t(doc_class, n)",
    "heatmap": f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings),
chosen AS (SELECT id, e FROM v WHERE n <= 50 OR place IN (SELECT floor(i * ((SELECT count(*) FROM embeddings) - 1)::DOUBLE / 49) FROM (SELECT unnest(range(50)) AS i)))
SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 5) + 0.0::DOUBLE AS cosine FROM chosen a JOIN chosen b ON a.id <= b.id""",
    "chunk_estimate": "SELECT greatest(1, coalesce(sum(length(text)), 0) // 462)::BIGINT AS chunks FROM documents",
}
