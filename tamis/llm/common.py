"""What the operators of this subpackage share: the word rule, scratch tables and column checks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words: blank and the control characters 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
#: For bytes.translate(): A-Z to a-z.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, whose task gives the system back what it has freed: Spark keeps the worker for later stages,
    and what the allocators hold back (some 250 MB after BPE) would count there with all that those need."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Freed memory that the allocators of Python, Arrow and C hold goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def scratch(spark: SparkSession) -> str:
    """A new path below the cluster's shared checkpoint folder; in tests, where none is set, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tamis-"))
            jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm_dir.get()
    return f"{base.rstrip('/')}/tamis-{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("tamis-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(rows: DataFrame, key: Column, most: int, weight: Column | None = None, slots: int = 1 << 10) -> DataFrame:
    """The rows whose hash of key lies under a threshold, chosen so that their weights (1 each) sum to `most` at most.

    The threshold is refined, slot by slot, until over half of `most` lie under it, so it never falls to nothing while
    smaller keys exist. What comes to the driver is `slots` sums for each step, whatever the size of rows."""
    h = F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1))
    w = F.lit(1) if weight is None else weight
    low, width, held = 0, 1 << 62, 0
    while True:
        step = max(1, width // slots)
        slot = F.expr("div(_h - {0}L, {1}L)".format(low, step))
        some = rows.select(h.alias("_h"), w.cast("long").alias("_w")).where((F.col("_h") >= low) & (F.col("_h") - low < width))
        sums = {r.s: r.w for r in some.groupBy(slot.alias("s")).agg(F.sum("_w").alias("w")).collect()}
        for s in sorted(sums):
            if held + sums[s] > most:
                low += s * step
                break
            held += sums[s]
        else:
            return rows.where(h < low + width) if low + width < 1 << 62 else rows
        if 2 * held >= most or step == 1:
            return rows.where(h < low)
        width = step


def row_keys(*columns: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that tell rows apart by these columns; nulls count as a value of their own."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts[::-1])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, trusted): good and not toxic, of the labelled documents."""
    return load(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("trusted"))


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
