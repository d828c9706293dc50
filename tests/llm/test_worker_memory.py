import os

import pyarrow as pa

from tamis.llm import bpe
from tamis.llm.common import tokenizer_file


def test_workers_give_back_what_a_stage_has_freed(spark):
    """Spark keeps its workers: what a stage leaves in them counts in the next one's memory (decontamination was stopped over 3000 MB)."""
    many = "concat_ws(' ', transform(sequence(0, 499), k -> translate(substr(sha2(concat(id, '.', k), 256), 1, 12), '0123456789', 'ghijklmnop')))"
    docs = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", f"{many} AS text")  # 500,000 distinct words a task
    assert bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.tiktoken")).agg({"n_tokens": "sum"}).head()[0] > 4_000_000

    def held(batches):
        for _ in batches:
            with open("/proc/self/status") as f:
                kb = next(int(line.split()[1]) for line in f if line.startswith("RssAnon"))
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([kb // 1024])], names=["pid", "mb"])

    rows = spark.range(0, 64, 1, 64).mapInArrow(held, "pid long, mb long").collect()
    assert max(r.mb for r in rows) < 140, rows
