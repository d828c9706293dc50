"""A vector store: Parquet, one folder per namespace."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import retrieval
from ..operators.embed import tried


class VectorStore:
    """Rows are doc_id, embedding (unit length), and the columns that came with them. Each write makes a new generation of
    its namespace and then switches to it, so a reader never meets half a write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.at = self.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.fs.Path("/".join([self.path, *parts]))

    def _read(self, name: str) -> dict:
        p = self._path(name)
        return json.loads(self.spark.read.text(str(p)).first()[0]) if self.at.exists(p) else {}

    def _write(self, name: str, value: dict) -> None:
        out = self.at.create(self._path(name), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def create_index(self, dimension: int) -> None:
        """Another dimension than before clears every namespace."""
        old = self._read("index.json").get("dimension")
        if old is not None and old != dimension:
            self.at.delete(self._path("namespaces"), True)
        self._write("index.json", {"dimension": dimension})

    def _folder(self, namespace: str) -> str | None:
        now = self._read(f"namespaces/{namespace}/current.json").get("generation")
        return None if now is None else f"{self.path}/namespaces/{namespace}/{now}"

    def rows(self, namespace: str = "default") -> DataFrame | None:
        folder = self._folder(namespace)
        return None if folder is None else self.spark.read.parquet(folder)

    def upsert(self, docs: DataFrame, namespace: str = "default") -> None:
        """Replaces rows of the same doc_id and adds the others; of an id that comes twice one row stays, the last by seq if there is that column."""
        dimension = self._read("index.json").get("dimension")
        if dimension is None:
            raise ValueError("create_index comes first")
        if docs.where(F.col("embedding").isNull() | (F.size("embedding") != dimension)).limit(1).count():
            raise ValueError(f"a vector doesn't have {dimension} numbers")
        order = F.desc("seq") if "seq" in docs.columns else F.desc(F.hash(*[c for c in docs.columns if c != "doc_id"]))
        new = docs.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).where("_n = 1").drop("_n")
        new = new.withColumn("embedding", V.normalise(F.col("embedding")).cast("array<float>"))
        old = self.rows(namespace)
        whole = new if old is None else old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)
        now = self._read(f"namespaces/{namespace}/current.json").get("generation", 0) + 1
        whole.write.mode("overwrite").parquet(f"{self.path}/namespaces/{namespace}/{now}")
        self._write(f"namespaces/{namespace}/current.json", {"generation": now})

    def query(self, queries: DataFrame, k: int = 10, namespace: str = "default", where: str | None = None) -> DataFrame:
        """Hits of queries (query_id, embedding); where filters rows before they are ranked. An empty namespace has none."""
        rows = self.rows(namespace)
        if rows is None:
            return self.spark.createDataFrame([], "query_id string, rank int, doc_id string, score double")
        return retrieval.dense_topk(rows.where(where) if where else rows, queries, k)

    def size(self, namespace: str = "default") -> int:
        rows = self.rows(namespace)
        return 0 if rows is None else rows.count()

    def delete_namespace(self, namespace: str) -> None:
        self.at.delete(self._path("namespaces", namespace), True)

    def delete(self) -> None:
        self.at.delete(self.fs.Path(self.path), True)


class RemoteStore:
    """The interface of VectorStore over a client object that is handed in, in batches; three tries, then the error."""

    BATCH, TRIES, TEXT, WAIT = 100, 3, 1000, 1.0

    def __init__(self, client):
        self.client = client

    def create_index(self, name: str, dimension: int, metric: str = "cosine") -> None:
        """Leaves an index of that dimension as it is; one of another dimension is an error."""
        if dimension < 1:
            raise ValueError("an index needs at least one dimension")
        old = self.client.describe(name)
        if old is None:
            self._tried(lambda: self.client.create(name, dimension, metric))
        elif old["dimension"] != dimension:
            raise ValueError(f"{name} has {old['dimension']} dimensions, not {dimension}")

    def delete_index(self, name: str) -> None:
        if self.client.describe(name) is not None:
            self._tried(lambda: self.client.delete(name))

    def delete_namespace(self, namespace: str) -> None:
        self._tried(lambda: self.client.delete_namespace(namespace))

    def stats(self) -> dict:
        """namespace: number of vectors."""
        return dict(self._tried(self.client.stats))

    def _tried(self, call):
        return tried(call, self.TRIES, self.WAIT)

    def upsert(self, docs: DataFrame, namespace: str = "default") -> None:
        client, batch, tries, wait, most = self.client, self.BATCH, self.TRIES, self.WAIT, self.TEXT

        def send(rows):
            held = []
            for r in rows:
                d = r.asDict(True)
                if not d["embedding"]:
                    raise ValueError(f"{d['doc_id']} has no vector")
                meta = {"text": (d.pop("text", None) or "")[:most]} | (d.pop("metadata", None) or {})
                held.append({"id": str(d["doc_id"]), "values": list(d["embedding"]), "metadata": meta})
                if len(held) == batch:
                    tried(lambda held=held: client.upsert(held, namespace), tries, wait)
                    held = []
            if held:
                tried(lambda: client.upsert(held, namespace), tries, wait)

        docs.foreachPartition(send)

    def query(self, vector: list, k: int = 10, namespace: str = "default", where: dict | None = None) -> list:
        if k < 1 or not len(vector):
            raise ValueError("a query needs a vector and a k of 1 or more")
        return self._tried(lambda: self.client.query(vector, k, namespace, where))

    def query_many(self, queries: DataFrame, k: int = 10, namespace: str = "default", where: dict | None = None) -> DataFrame:
        """Hits of queries (query_id, embedding), asked from the executors; client.query gives (id, score) pairs, best first."""
        client, tries, wait = self.client, self.TRIES, self.WAIT
        own = queries.select("query_id", "embedding")

        def run(batches):
            import pyarrow as pa

            for b in batches:
                found = [(q, n + 1, str(i), float(s)) for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (i, s) in enumerate(tried(lambda v=v: client.query(v, k, namespace, where), tries, wait))]
                cols = list(zip(*found)) or [[], [], [], []]
                kinds = (b.column(0).type, pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["query_id", "rank", "doc_id", "score"])

        return own.mapInArrow(run, f"query_id {own.schema['query_id'].dataType.simpleString()}, rank int, doc_id string, score double")


def open_store(spark: SparkSession, kind: str, **options):
    if kind == "local":
        return VectorStore(spark, **options)
    if kind == "remote":
        return RemoteStore(**options)
    raise ValueError(f"no vector store {kind!r}; there are local and remote")


__all__ = ["RemoteStore", "VectorStore", "open_store"]
