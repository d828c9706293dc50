import hashlib

from helpers import DOCS
from tamis.llm import common
from tamis.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least, keep):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    seen, first = {}, {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            seen.setdefault(key(x), set()).add(i)
            first[key(x)] = min(first.get(key(x), (i, p)), (i, p))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [bool(key(x)) and len(seen[key(x)]) >= least and not (keep == "first" and first[key(x)] == (i, p)) for p, x in enumerate(lines)]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def test_matches_brute_force(spark):
    rows = [(i, f"Head line\n\n  head LINE\t\nown {i}\nshared {i % 3}\n") for i in range(12)]
    rows += [(12, None), (13, ""), (14, "\n"), (15, "HEAD LINE"), (16, "é\nÉ"), (17, "\n".join(["x"] * 3000 + ["head line"] * 3000))]
    df = spark.createDataFrame([(*r, "kept text") for r in rows], DOCS + ", kept string")
    for least, keep in ((4, "none"), (10, "none"), (2, "first"), (1, "first")):
        got = dedup_lines(df, least, keep=keep).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == brute(rows, least, keep)
        for r in got:
            assert sum(r.keep_bitmap) == r.n_lines and sum(r.keep_bitmap[1::2]) == r.n_dropped


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a"), (None, None)], DOCS)
    got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(df, 2).collect())
    assert got == [(-1, 1, 0, ""), (-1, 1, 1, ""), (1, 2, 1, "b"), (1, 2, 1, "b")]
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_nothing_dropped_keeps_the_text(spark):
    (r,) = dedup_lines(spark.createDataFrame([(1, "a\n\nb")], DOCS)).collect()
    assert hashlib.sha256(r.kept.encode()).hexdigest() == hashlib.sha256(b"a\n\nb").hexdigest() and r.keep_bitmap == [3]


def test_line_rows_are_made_once_and_not_written(spark, monkeypatch):
    """A scratch file for each task meant two processes (chmod) for each; children of an executor counted with its memory (stopped over 3000 MB)."""
    asked, threshold = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr("tamis.llm.common.scratch", lambda s, f=common.scratch: asked.append(f(s)) or asked[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        for keep in ("none", "first"):
            out = dedup_lines(spark.createDataFrame([(i, f"head\nown {i}\nhead") for i in range(40)], DOCS), 10, keep=keep)
            assert sorted((r.doc_id, r.n_dropped) for r in out.collect()) == [(i, 2 if i or keep == "none" else 1) for i in range(40)]
            assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert asked == []
