"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes all that the stage before kept, as Parquet, and returns rows with the columns of documents; the last
returns the digests of the encoded and decoded texts.

Defined results: extra columns are carried, whatever their names; rows are told apart by doc_id and text, so rows that
share a doc_id, or have none, are judged each by itself; repeated rows are one after the third stage; null and empty
texts fail the quality rules; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import bpe, decontaminate, line_dedup, quality_rules, similar
from tamis.llm.common import load, table, tokenizer_file, trusted_labels


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, trusted_labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; a document stays, with what is left of its text."""
    own = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    out = line_dedup.dedup_lines(own, min_docs=10, min_chars=1, keep="none")
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a similarity of 0.8 or more) stays: the one of smallest id."""
    return similar.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", leaks), ("bpe", tokens)]

#: SQL can't express the quality rules' model, SimHash components or byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
