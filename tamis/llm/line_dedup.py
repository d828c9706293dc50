"""Line dedup with DataFrame functions only.

Every line with a key becomes a row of two 64-bit hashes, its document and its position. The rows are dealt by
(hash, salt) and sorted by hash, salt, document and position; the salt comes from the document, so a line that a
third of all documents share still lies in SALTS pieces. Each piece is streamed once: a document that differs from the
row before counts, the first row is the piece's first occurrence. The pieces of a key are summed after that, at most
SALTS rows each. The pieces of keys that qualify meet the line rows again, piece by piece, and what is dropped comes
back as one run-length compressed keep bitmap per document: [kept, dropped, kept, ...] lines. Texts meet their bitmaps
at the end.

Nothing is written but shuffles. Both uses of the line rows need the same columns, dealt the same way, so Spark makes
that shuffle once and reads it twice (a test holds it to that); a scratch table would be a file for each task, and on
a local store Hadoop starts two processes (chmod) for each.

Defined results: a null or empty text is one empty line; lines whose key is shorter than min_chars always stay; rows
with the same doc_id are one document for counting, and each keeps its own row; a null doc_id is a document of its own;
columns of the input named n_lines, n_dropped, keep_bitmap or kept are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, row_keys

SALTS = 1024


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per line with a key: h, g (hashes of the key), s (salt), doc_id, r, q (hashes of the row), pos."""
    key = lambda x: ascii_lower(F.btrim(x, F.lit(SPACE)))
    r, q = row_keys("doc_id", "text")
    rows = docs.select("doc_id", r.alias("r"), q.alias("q"), F.posexplode(F.transform(_lines(F.col("text")), key)).alias("pos", "key"))
    rows = rows.where(F.char_length("key") >= min_chars)
    return rows.select(
        F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), F.xxhash64("doc_id").bitwiseAND(F.lit(SALTS - 1)).cast("int").alias("s"), "doc_id", "r", "q", "pos"
    )


def shared_keys(rows: DataFrame, min_docs: int) -> DataFrame:
    """h, g, s, first (doc_id, pos): the pieces of the keys in min_docs documents or more."""
    w = Window.partitionBy("h", "g", "s").orderBy("doc_id", "pos", "r", "q")
    streamed = rows.select("*", F.row_number().over(w).alias("rn"), F.lag("doc_id").over(w).alias("before"))
    streamed = streamed.withColumn("new_doc", ((F.col("rn") == 1) | ~F.col("doc_id").eqNullSafe(F.col("before"))).cast("long"))
    pieces = streamed.groupBy("h", "g", "s").agg(F.sum("new_doc").alias("n"), F.min(F.when(F.col("rn") == 1, F.struct("doc_id", "pos"))).alias("first"))
    key = Window.partitionBy("h", "g")
    summed = pieces.select("h", "g", "s", F.sum("n").over(key).alias("n_docs"), F.min("first").over(key).alias("first"))
    return summed.where(F.col("n_docs") >= min_docs).drop("n_docs")


def _with_bitmap(df: DataFrame) -> DataFrame:
    """Adds keep_bitmap from _dropped (sorted positions) and n_lines: [2, 1, 3] keeps two lines, drops one, keeps three."""
    at = lambda i: F.get("_dropped", i)
    starts = F.filter("_dropped", lambda p, i: (i == 0) | (at(i - 1) != p - 1))
    ends = F.filter("_dropped", lambda p, i: (i == F.size("_dropped") - 1) | (at(i + 1) != p + 1))
    df = df.withColumn("_starts", starts).withColumn("_ends", ends)
    pairs = F.transform("_starts", lambda p, j: F.array(p - F.when(j == 0, 0).otherwise(F.get("_ends", j - 1) + 1), F.get("_ends", j) - p + 1))
    tail = F.array(F.col("n_lines").cast("int") - F.coalesce(F.get("_ends", F.size("_ends") - 1) + 1, F.lit(0)))
    return df.withColumn("keep_bitmap", F.concat(F.flatten(pairs), tail)).drop("_starts", "_ends")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """r, q, dropped (sorted positions) for the rows of docs that lose lines.

    keep="none" drops every line of a key in min_docs documents or more; keep="first" leaves its first line in the
    document order.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    rows = line_rows(docs, min_chars)
    own, first = F.struct(rows["doc_id"], rows["pos"]), F.col("keys.first")
    keys = shared_keys(rows, min_docs).alias("keys")
    lost = rows.join(keys, ["h", "g", "s"]).where(own >= first if keep == "none" else own > first)
    return lost.groupBy("r", "q").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """docs with n_lines, n_dropped, keep_bitmap (run lengths, kept first) and kept (the text that stays)."""
    own = docs.drop("n_lines", "n_dropped", "keep_bitmap", "kept")
    r, q = row_keys("doc_id", "text")
    bitmaps = keep_bitmaps(own, min_docs, min_chars, keep).select(F.col("r").alias("_r"), F.col("q").alias("_q"), F.col("dropped").alias("_dropped"))
    marked = own.join(bitmaps, (r == F.col("_r")) & (q == F.col("_q")), "left").drop("_r", "_q")
    none = F.array().cast("array<int>")
    marked = marked.withColumn("n_lines", F.size(_lines(F.col("text"))).cast("long")).withColumn("_dropped", F.coalesce("_dropped", none))
    marked = _with_bitmap(marked.withColumn("n_dropped", F.size("_dropped").cast("long")))
    flags = F.flatten(F.transform("keep_bitmap", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    left = F.filter(F.arrays_zip(_lines(F.col("text")).alias("line"), flags.alias("on")), lambda x: x["on"])
    kept = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    return marked.withColumn("kept", kept).drop("_dropped")
