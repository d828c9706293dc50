"""Tables between the steps of a long plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that the cluster shares; a temporary one where the master is local and none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tamis-")
    return f"{base.rstrip('/')}/tamis-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written below the shared checkpoint folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are sent to every executor at most.
IDS = 1_000_000


def _met(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    ids = written(ids.select("doc_id"))
    return rows.join(F.broadcast(ids) if ids.count() <= IDS else ids, "doc_id", how)


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id ids has. Up to IDS ids go to the rows, so texts stay where they lie; beyond, both are shuffled."""
    return _met(rows, ids, "left_semi")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id ids doesn't have, as only() does it."""
    return _met(rows, ids, "left_anti")


def drop(*tables: DataFrame) -> None:
    """Removes the files of written() tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("tamis-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
