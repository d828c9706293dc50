"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, tokenizer_file, trusted_labels

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 2 good, 1 good but toxic or poor, 0 both poor and toxic; kept where the highest grade is the likelier side."""
    from .quality_classifier import fit, score

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return score(docs, fit(docs, ratings))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_file import round_trip

    return round_trip(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_edited

    return count_edited(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"), shingle=4, radius=4)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(load(spark, sf_dir, "documents"), trusted_labels(spark, sf_dir)).drop("r", "q")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_corpus

    return score_corpus(load(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(load(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_file": op2_token_file,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe": op4_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_score": op8_lm_score,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "pipeline": pipeline,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_line_dedup": f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, shared.key IS NOT NULL AS gone FROM keyed LEFT JOIN shared ON keyed.key = shared.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_url_filter": f"""
WITH rules(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('block', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
}
