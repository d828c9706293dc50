import json

import pytest

from tamis.operators import chunk
from tamis.sources import csv_files, evalgen, pages, reports
from tamis.sources.vector_store import VectorStore, open_store


def test_fixed_windows():
    c = chunk.Chunker()
    assert [len(x) for x in c.fixed("x" * 512)] == [512, 50]
    assert [len(x) for x in chunk.Chunker(tail=False).fixed("x" * 512)] == [512]
    assert c.fixed("a" * 50 + " " + "b" * 1000)  # ends, though a break lies where the next window would start
    text = "word " * 300
    got = c.fixed(text)
    assert all(len(x) <= 512 for x in got) and got[0].endswith("word")


def test_sentences_and_paragraphs():
    c = chunk.Chunker(size=40, overlap=5, least=1)
    assert c.sentences("One is here. Two is here. Three is here. Four.") == ["One is here. Two is here.", "Two is here. Three is here. Four."]
    assert c.sentences("  ") == [] and c.paragraphs("a\n\nb\n \nc") == ["a\n\nb\n\nc"]
    assert c.paragraphs("x" * 30 + "\n\n" + "y" * 30) == ["x" * 30, "y" * 30]


def test_large_batches_are_cut_piece_by_piece(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunk, "PIECE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 4, None, "b" * 5, "c" * 30, "", "d"])], names=["doc_id", "text"])
    parts = list(chunk._pieces(batch))
    assert [p.num_rows for p in parts] == [3, 1, 2] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(chunk._pieces(batch.slice(0, 0))) == []


def test_chunk_numbers_have_gaps(spark):
    docs = spark.createDataFrame([(1, "Short one. " + "x" * 600 + ". End."), (2, None)], "doc_id long, text string")
    rows = chunk.chunk(docs, "sentence").orderBy("chunk_index").collect()
    assert all(len(r.text) >= 50 and r.doc_id == 1 for r in rows) and rows[0].chunk_index == 1 and rows[0].chunk_id == "1_chunk_1"
    assert chunk.estimate(docs.limit(0)).first().chunks == 1
    with pytest.raises(ValueError):
        chunk.chunk(docs, "words")


def test_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('key,text,tag\na,"one\ntwo",x\n,  padded ,\nc,nan,y\nd,,z\n')
    got = {r.doc_id: r for r in csv_files.documents(spark, str(tmp_path / "d.csv"), id_column="key").collect()}
    assert set(got) == {"a", "d.csv_row_1"} and got["a"].text == "one\ntwo" and got["d.csv_row_1"].text == "padded"
    assert got["a"].metadata == {"source": "d.csv", "row": "0", "type": "csv", "tag": "x"}
    (tmp_path / "g.csv").write_text('query,relevant_doc_ids\nwhat,"a, b,,"\nwhy,c\n')
    queries, qrels = csv_files.ground_truth(spark, str(tmp_path / "g.csv"))
    assert {(r.query_id, r.doc_id) for r in qrels.collect()} == {("query_0", "a"), ("query_0", "b"), ("query_1", "c")} and queries.count() == 2
    assert csv_files.columns(spark, str(tmp_path / "g.csv")) == ["query", "relevant_doc_ids"] and csv_files.preview(spark, str(tmp_path / "g.csv"), 1).count() == 1
    with pytest.raises(ValueError):
        csv_files.documents(spark, str(tmp_path / "d.csv"), text_column="body")


def test_pages(spark, tmp_path):
    (tmp_path / "book.pdf").write_bytes(b"first page text\n\n  more |tiny|third   page text")
    got = pages.read(spark, str(tmp_path / "book.pdf"), extract=lambda b: b.decode().split("|"))
    assert [(r.doc_id, r.text) for r in got.orderBy("page").collect()] == [("book.pdf_page_1", "first page text more"), ("book.pdf_page_3", "third page text")]
    assert pages.one_per_file(got).first().text == "first page text more\n\nthird page text"


def test_vector_store(spark, tmp_path):
    store = open_store(spark, "local", path=str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, embedding array<float>, text string")
    with pytest.raises(ValueError):
        store.upsert(rows(("a", [1.0, 0.0], "x")))
    store.create_index(2)
    store.upsert(rows(("a", [3.0, 0.0], "x"), ("b", [0.0, 5.0], "y")))
    store.upsert(rows(("a", [0.0, 2.0], "new"), ("c", [1.0, 1.0], "z")))
    store.upsert(rows(("a", [1.0, 0.0], "x")), "other")
    assert store.size() == 3 and store.size("other") == 1 and store.size("none") == 0
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<float>")
    assert [(r.doc_id, r.score) for r in store.query(q, 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0)]
    assert [r.doc_id for r in store.query(q, 2, where="text <> 'new'").orderBy("rank").collect()] == ["b", "c"] and store.query(q, 2, "none").count() == 0
    with pytest.raises(ValueError):
        store.upsert(rows(("a", [1.0], "x")))
    store.delete_namespace("other")
    assert store.size("other") == 0
    store.create_index(3)
    assert store.size() == 0 and isinstance(store, VectorStore)


def test_generator_is_seeded_and_counted():
    a, b, c = evalgen.generate(42), evalgen.generate(42), evalgen.generate(1)
    assert a.documents == b.documents and a.qrels == b.qrels and a.documents != c.documents
    assert len(a.documents) == 222 and len(a.queries) == 60
    kinds = [k for _, k, _, _ in a.labels]
    assert [kinds.count(k) for k in ("gold", "relevant", "related", "irrelevant", "exact_dup", "near_dup", "low_quality")] == [40, 40, 80, 20, 15, 15, 12]
    text = {d: t for d, t, _ in a.documents}
    assert all(d in text for _, d in a.qrels) and sum(q.startswith("qc_") for q, _ in a.queries) == 20


def test_cli_end_to_end(spark, tmp_path):
    from tamis.plans import cli

    evalgen.generate(topics=8, irrelevant=4, exact=4, near=4, junk=6).write_csv(spark, str(tmp_path / "eval"))
    report = cli.run(spark, str(tmp_path / "eval"), k=5, out=str(tmp_path / "out"))
    assert report["scan"]["total_documents"] == 50 and report["attribution"]["dedup_recall"] >= 0.5
    assert len(report["arms"]) == 8 and all(0 <= a["ndcg"] <= 1 and a["low"] <= a["ndcg"] + 1e-6 for a in report["arms"])
    assert json.loads((tmp_path / "out/benchmark_moderate_two_stage_k5.json").read_text())["config"]["k"] == 5
    assert "## Summary" in (tmp_path / "out/benchmark_moderate_two_stage_k5.md").read_text()


def test_reports_escape():
    assert "&lt;b&gt;" in reports.as_html("t", {"x": [{"a": "<b>"}]}) and "(none)" in reports.as_markdown("t", {"x": []})


def test_a_column_named_as_the_loader_names_its_own(spark, tmp_path):
    (tmp_path / "d.csv").write_text("text,source,row\nsome text,web,7\n")
    (r,) = csv_files.documents(spark, str(tmp_path / "d.csv")).collect()
    assert r.metadata == {"type": "csv", "source": "web", "row": "7"} and r.doc_id == "d.csv_row_0"


def test_uploads_of_both_kinds(spark):
    paged = spark.createDataFrame([("a_page_1", "a", "Short page."), ("a_page_2", "a", "A sentence of the long page. " * 40)], "doc_id string, source string, text string")
    rows = spark.createDataFrame([("r1", "d.csv", "x" * 900), ("r2", "d.csv", "y")], "doc_id string, source string, text string")
    got = pages.upload([paged], [rows]).collect()
    assert {r.doc_id for r in got if r.source == "d.csv"} == {"r1", "r2"}
    mine = [r for r in got if r.source == "a"]
    assert "a_page_1" in {r.doc_id for r in mine} and all(len(r.text) <= 512 for r in mine)
    assert [r.doc_id for r in mine if r.doc_id != "a_page_1"] == [f"a_page_2_chunk_{k}" for k in range(len(mine) - 1)] and len(mine) > 3


def test_chunk_queries_equal_the_chunker(spark):
    from tamis import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for strategy in chunk.STRATEGIES:
        got = sorted((r.doc_id, r.chunk_index, r.total_chunks, r.text) for r in queries.QUERIES[f"chunk_{strategy}"](spark, sf).collect())
        want = []
        for i, t in texts.items():
            made = chunk.Chunker().chunks(t or "", strategy)
            assert strategy == "fixed" or "".join(t.split()) in "".join("".join(x.split()) for x in made) or len(made) > 1
            want += [(i, k, len(made), x) for k, x in enumerate(made) if len(x) >= 50]
        assert got == sorted(want)


def fake_client(folder):
    class FakeClient:
        """Fails once before each success; keeps what it gets in a folder, as the executors run elsewhere."""

        def __init__(self, folder):
            self.folder = str(folder)

        def _flaky(self, name):
            import os

            if not os.path.exists(f"{self.folder}/{name}"):
                open(f"{self.folder}/{name}", "w").close()
                raise ConnectionError("try again")

        def embed(self, texts, kind):
            self._flaky(f"embed{len(texts)}")
            return [[float(len(t)), 1.0] for t in texts]

        def describe(self, name):
            return {"dimension": 2} if name == "there" else None

        def create(self, name, dimension, metric):
            self._flaky("create")

        def stats(self):
            self._flaky("stats")
            return {"default": 3}

        def query(self, vector, k, namespace, where):
            return [("a", 1.0), ("b", 0.5)][:k]

        def upsert(self, rows, namespace):
            import json
            import uuid

            with open(f"{self.folder}/up-{uuid.uuid4().hex}.json", "w") as f:
                json.dump([r["id"] for r in rows], f)

    return FakeClient(folder)  # made here, so that it is sent to the workers by value


def test_remote_services(spark, tmp_path):
    from tamis.operators import embed
    from tamis.sources.vector_store import RemoteStore

    client = fake_client(tmp_path)
    docs = spark.createDataFrame([(str(i), "x" * i) for i in range(5)], "doc_id string, text string").coalesce(1)
    p = embed.provider("remote", client=client, dimension=2, wait=0.0)
    made = p.embed(docs)
    assert sorted((r.doc_id, list(r.embedding)) for r in made.collect()) == [(str(i), [float(i), 1.0]) for i in range(5)]
    with pytest.raises(Exception, match="3 numbers"):
        embed.provider("remote", client=client, dimension=3, wait=0.0).embed(docs).collect()
    store = open_store(spark, "remote", client=client)
    assert isinstance(store, RemoteStore)
    RemoteStore.WAIT = 0.0
    store.create_index("new", 2)
    store.create_index("there", 2)
    with pytest.raises(ValueError):
        store.create_index("there", 3)
    with pytest.raises(ValueError):
        store.query([], 3)
    assert store.stats() == {"default": 3} and store.query([1.0, 0.0], 1) == [("a", 1.0)]
    store.upsert(made.join(docs, "doc_id"))
    assert sorted(i for f in tmp_path.glob("up-*.json") for i in json.loads(f.read_text())) == [str(i) for i in range(5)]
    hits = store.query_many(made.selectExpr("doc_id AS query_id", "embedding"), 2).collect()
    assert len(hits) == 10 and {(r.rank, r.doc_id) for r in hits} == {(1, "a"), (2, "b")}


def test_a_model_as_reranker(spark):
    from tamis.operators import retrieval

    hits = spark.createDataFrame([("q", k + 1, d, 1.0) for k, d in enumerate("abc")], "query_id string, rank int, doc_id string, score double")
    queries = spark.createDataFrame([("q", "say")], "query_id string, query string")
    docs = spark.createDataFrame([("a", "x"), ("b", "xxx"), ("c", "xx")], "doc_id string, text string")
    got = retrieval.rerank(hits, queries, docs, 2, retrieval.scored_by(lambda q, t: [len(x) for x in t], batch=2))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == ["b", "c"]


def test_scan_tells_its_progress_and_takes_other_stats(spark):
    from tamis.operators import quality
    from tamis.plans import scan

    docs = spark.createDataFrame([(1, "Some words that say a thing."), (2, "Some words that say a thing."), (3, "Other words here.")], "doc_id long, text string")
    seen = []
    found = scan.scan(docs, method="jaccard", threshold=0.8, stats=lambda d, s: quality.doc_stats(d.where("doc_id < 3"), s), progress=lambda name, done: seen.append((name, done)))
    assert found.stats.count() == 2 and found.clusters.count() == 2
    assert [d for _, d in seen] == sorted(d for _, d in seen) and seen[-1] == ("done", 1.0)


def test_removed_documents_and_percentages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A fine text, long enough, with words."), (2, 'x"y'), (3, None)], "doc_id long, text string")
    from tamis.operators import clean, quality

    decided = clean.decide(docs, "aggressive")
    reports.removed_csv(docs, decided, str(tmp_path / "gone"))
    got = {r.doc_id: (r.text, r.reason) for r in csv_files.read(spark, str(tmp_path / "gone")).collect()}
    assert got == {"2": ('x"y', "too_short"), "3": (None, "too_short")}
    (r,) = reports.percentages(quality.doc_stats(docs), decided).collect()
    assert r.documents == 3 and round(r.retained_percent, 2) == 33.33 and round(r.issue_percent, 2) == 66.67


def test_csv_files_give_back_what_was_written(spark, tmp_path):
    from pyspark.sql import functions as F

    odd = ["a ", " a", "\ta\t", "a\r", "\ra", "a\r\nb", "a\nb\n", "\n", " ", '"', 'a"', '"a"', 'a""b', "\\", 'a\\"', ",", "a\x00", 'a\x00"b', "\x01", "x\x1f", "\u3000x ", '","', '"\n"']
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    reports.removed_csv(docs, docs.select("doc_id", F.lit("too_short").alias("reason")), str(tmp_path / "gone"))
    assert {int(r.doc_id): r.text for r in csv_files.read(spark, str(tmp_path / "gone")).collect()} == dict(enumerate(odd))


def test_summary_of_metrics(spark):
    from tamis.operators import metrics

    hits = spark.createDataFrame([("q", 3, "d", 1.0), ("q", 1, "e", 2.0), ("q", 2, "f", 1.5)], "query_id string, rank int, doc_id string, score double")
    asked = spark.createDataFrame([("q", "x")], "query_id string, query string")
    truth = spark.createDataFrame([("q", "d")], "query_id string, doc_id string")
    assert tuple(metrics.summary(hits, truth, asked, 3).first()) == (3, 0.5, 1.0, 0.3333, 0.3333, 1.0)
    with pytest.raises(ValueError):
        metrics.summary(hits, truth, asked.limit(0), 3)
