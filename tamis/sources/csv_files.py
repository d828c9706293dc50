"""CSV corpora and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TRIM = r"(?U)^\s+|\s+$"


def read(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', encoding=encoding)


def write(df: DataFrame, path: str) -> None:
    """A CSV folder that read() gives back as it was: blanks at the ends of a value stay, and so does a zero byte before a quote."""
    df.write.csv(path, header=True, escape='"', charToEscapeQuoteEscaping='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def columns(spark: SparkSession, path: str) -> list[str]:
    return read(spark, path).columns


def preview(spark: SparkSession, path: str, rows: int = 5) -> DataFrame:
    return read(spark, path).limit(rows)


def _need(df: DataFrame, *names: str | None) -> None:
    missing = [n for n in names if n and n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def _numbered(df: DataFrame) -> DataFrame:
    """_file and _row: the place of each row in its file, from 0, in the order in which Spark reads the file.

    A file with multi-line records is read by one task, so its rows keep their order there; no window over all files is
    needed."""
    place = df.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn("_at", F.monotonically_increasing_id())
    return place.withColumn("_row", F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 1).drop("_at")


def documents(spark: SparkSession, path: str, text_column: str = "text", id_column: str | None = None, metadata_columns: list[str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """doc_id, text, metadata (map), doc_ord. Blank texts and the word nan go; without an id column ids are {file}_row_{n}."""
    raw = read(spark, path, encoding)
    _need(raw, text_column, id_column, *(metadata_columns or []))
    own = _numbered(raw).withColumn("_text", F.regexp_replace(F.col(text_column), _TRIM, "")).where("_text is not null and _text <> '' and lower(_text) <> 'nan'")
    made = F.concat("_file", F.lit("_row_"), F.col("_row"))
    ids = made if id_column is None else F.coalesce(F.nullif(F.col(id_column).cast("string"), F.lit("")), made)
    more = metadata_columns if metadata_columns is not None else [c for c in raw.columns if c not in (text_column, id_column)]
    # a column of the file named as one of these takes its place
    pairs = [x for k, v in (("source", F.col("_file")), ("row", F.col("_row").cast("string")), ("type", F.lit("csv"))) if k not in more for x in (F.lit(k), v)]
    for c in more:
        pairs += [F.lit(c), F.col(c).cast("string")]
    return own.select(ids.alias("doc_id"), F.col("_text").alias("text"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metadata"), F.col("_row").alias("doc_ord"))


def ground_truth(spark: SparkSession, path: str, query_column: str = "query", relevant_column: str = "relevant_doc_ids", id_column: str | None = None, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(queries: query_id, query; qrels: query_id, doc_id)."""
    raw = read(spark, path)
    _need(raw, query_column, relevant_column, id_column)
    own = _numbered(raw).withColumn("query", F.regexp_replace(F.col(query_column), _TRIM, "")).where("query is not null and query <> '' and lower(query) <> 'nan'")
    ids = F.concat(F.lit("query_"), F.col("_row")) if id_column is None else F.col(id_column).cast("string")
    own = own.withColumn("query_id", ids)
    parts = F.filter(F.transform(F.split(F.col(relevant_column), r"\Q" + delimiter + r"\E"), lambda x: F.regexp_replace(x, _TRIM, "")), lambda x: x != "")
    return own.select("query_id", "query"), own.select("query_id", F.explode(parts).alias("doc_id")).distinct()


def evaluation_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(documents, queries, qrels, labels or None) of a folder with documents.csv, ground_truth.csv and, maybe, doc_labels.csv; blank texts stay."""
    raw = read(spark, f"{folder}/documents.csv")
    docs = raw.select(F.col("id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[c for c in raw.columns if c not in ("id", "text")])
    queries, qrels = ground_truth(spark, f"{folder}/ground_truth.csv", id_column="query_id")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/doc_labels.csv")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return docs, queries, qrels, None
    labels = read(spark, f"{folder}/doc_labels.csv").withColumn("answer_bearing", F.col("answer_bearing") == "True")
    return docs, queries, qrels, labels
