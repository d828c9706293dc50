"""Paged documents (PDF): one row per page, or per file. Text extraction is a plug-in: any function bytes -> list of page texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_page(text):
    """Lines are stripped, blank ones go, the rest is joined by blanks, runs of blanks become one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.regexp_replace(F.array_join(lines, " "), " +", " ")


def pdf_text(data: bytes) -> list[str]:
    """Page texts by PyMuPDF, if that is installed."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as book:
        return [page.get_text() for page in book]


def read(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] = pdf_text, least: int = 10) -> DataFrame:
    """doc_id ({file}_page_{n}, from 1), source, page, text of pages with `least` characters or more."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract(x.as_py()) for x in b.column(1)], pa.list_(pa.string()))], names=["path", "pages"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pages array<string>")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.posexplode("pages").alias("at", "raw"))
    rows = rows.select("source", (F.col("at") + 1).alias("page"), clean_page(F.col("raw")).alias("text")).where(F.char_length("text") >= least)
    return rows.select(F.concat("source", F.lit("_page_"), F.col("page")).alias("doc_id"), "source", "page", "text")


def one_per_file(pages: DataFrame) -> DataFrame:
    """doc_id (the file), text: the pages in order, a blank line between them."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    return pages.groupBy(F.col("source").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def upload(paged: list[DataFrame], rows: list[DataFrame], most: int = 512) -> DataFrame:
    """doc_id, source, text of several uploads in one table: pages (of read()) over `most` characters are cut into
    sentence chunks, shorter ones and CSV rows stay as they are."""
    from ..operators import chunk

    parts = [x.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text") for x in rows]
    for x in paged:
        own = x.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
        parts.append(own.where(F.char_length("text") <= most))
        # a chunk's source comes with its id, so nothing is joined
        named = own.where(F.char_length("text") > most).select(F.struct("doc_id", "source").alias("doc_id"), "text")
        cut = chunk.chunk(named.select(F.to_json("doc_id").alias("doc_id"), "text"), "sentence", chunk.Chunker(most))
        back = F.from_json("doc_id", "doc_id string, source string")
        parts.append(cut.select(F.concat(back["doc_id"], F.lit("_chunk_"), F.col("chunk_index")).alias("doc_id"), back["source"].alias("source"), "text"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
