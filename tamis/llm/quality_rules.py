"""Quality rules: fixed base rules, and the log-likelihood ratio of hashed n-grams between trusted texts and all texts.

Two multinomials are counted over all documents: the raw corpus, and the target, the trusted documents. They are counted
twice: over byte 5-grams in 2^18 buckets, for what is common, and over byte 7-grams in 2^22, for rare words. With target
count t, raw count r and k pseudo-counts, a gram's ratio is log((t + k) / (r T/R + k)): what was hardly ever seen says
nothing. A text gets three length-normalised figures: the mean ratio of its 5-grams, the mean of what of these lies
under -EVIDENCE, which a few damning words in a long good text still move, and the same of its 7-grams. All are cut by
thresholds that come from labelled documents that the counts have not seen: one trusted document in five, by hash, and
all untrusted ones. Each of the first two cuts is the one, on a fixed grid, that catches the most untrusted documents
less CARE times the clean ones it loses (and one more, as few labels prove little); the last is chosen on what the first two keep, with RARE_CARE.

The trusted ids meet the documents (a broadcast up to BROADCAST ids, a sort-merge join beyond); raw and target counts,
thresholds and verdicts cover all documents. Of the 7-gram ratios only those under -EVIDENCE are broadcast.

Defined results: a null or empty text has no words, no grams and figures of zero, and fails the base rules; a document
without a label is raw only; repeated rows are judged and counted each; without labelled documents on both sides
nothing is cut by the method.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, frugal, row_keys, table
from .grams import BITS, hashed, pieces, row_sums

SYMBOLS = "#*$%&|<>"
PSEUDO = 5.0
EVIDENCE = 0.5
CARE = 10.0
RARE_CARE = 20.0
#: Width and bits of the two families of grams.
FAMILIES = ((5, BITS), (7, 22))
#: Input partitions that a counting task takes: it sends a row per bucket, however much it has read.
GATHER = 8
#: Trusted ids that are sent to every executor at most; more meet the documents in a sort-merge join.
BROADCAST = 1_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIGURES = ("llr", "damning", "rare")
#: Steps of the grid between -4 and 1 on which the cuts lie.
GRID = 20_000


def repeated_words(words: list) -> int:
    """How many words stand in a 3-word window that the list has twice or more."""
    n = len(words)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    v = len(number)
    if n < 4 or v == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pair = ids[:-2] * v + ids[1:-1]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair * v + ids[2:]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(code, twice)
    on = np.zeros(n, bool)
    on[:-2] |= hit
    on[1:-1] |= hit
    on[2:] |= hit
    return int(on.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()
    seen: set = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """text and on: whether the doc_id is one of trusted (distinct)."""
    if trusted.count() <= BROADCAST:
        trusted = F.broadcast(trusted)
    return docs.select("doc_id", "text").join(trusted.select("doc_id", F.lit(True).alias("on")), "doc_id", "left").select("text", "on")


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(family, bucket, raw, target): raw over all docs, target over the trusted ones (distinct doc_id)."""

    @frugal
    def run(batches):
        # untrusted and trusted counts of a bucket lie side by side
        sums = [np.zeros(2 << bits, np.int32) for _, bits in FAMILIES]
        for b in batches:
            for part in pieces(b, 0, 1_000_000):
                on = part.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int32)
                for (width, bits), total in zip(FAMILIES, sums):
                    buckets, first = hashed(part.column(0), width, bits)
                    code = np.sort(buckets * 2 + np.repeat(on, np.diff(first)))
                    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else code
                    total[code[starts]] += np.diff(np.r_[starts, len(code)]).astype(np.int32)
        for family, total in enumerate(sums):
            pair = total.reshape(-1, 2)
            at = np.flatnonzero(pair.any(1))
            for i in range(0, len(at), 1 << 15):
                p = at[i : i + (1 << 15)]
                target = pair[p, 1].astype(np.int64)
                cols = [pa.array(np.full(len(p), family, np.int8)), pa.array(p.astype(np.int32)), pa.array(pair[p, 0] + target), pa.array(target)]
                yield pa.RecordBatch.from_arrays(cols, names=["family", "bucket", "raw", "target"])

    read = flagged(docs, trusted)
    few = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // GATHER))
    parts = read.coalesce(few).mapInArrow(run, "family tinyint, bucket int, raw long, target long")
    return parts.groupBy("family", "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame, pseudo: float = PSEUDO) -> tuple[np.ndarray, np.ndarray]:
    """The log ratio of each 5-gram bucket; of each 7-gram bucket what of it lies under -EVIDENCE, the only ones to come to the driver."""
    totals = {r.family: (r.raw, r.target) for r in counts.groupBy("family").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()}
    out = [np.zeros(1 << bits, np.float32) for _, bits in FAMILIES]
    on = {k: t / r for k, (r, t) in totals.items() if t}
    if not on:
        return out[0], out[1]
    share = F.element_at(F.create_map(*(F.lit(x) for k in on for x in (k, on[k]))), F.col("family").cast("int"))
    ratio = F.log((F.col("target") + pseudo) / (F.col("raw") * share + pseudo)).cast("float")
    found = counts.where(F.col("family").isin(list(on))).select("family", "bucket", ratio.alias("ratio"))
    for b in found.where((F.col("family") == 0) | (F.col("ratio") < -EVIDENCE)).toArrow().to_batches():
        family, bucket, value = (b.column(i).to_numpy() for i in range(3))
        out[0][bucket[family == 0]] = value[family == 0]
        out[1][bucket[family == 1]] = value[family == 1] + np.float32(EVIDENCE)
    return out[0], out[1]


def score(docs: DataFrame, ratio: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, r, q (hashes of doc_id and text), the base counts, llr (mean ratio), damning and rare (means of what lies under -EVIDENCE)."""
    at = np.flatnonzero(ratio[1])
    shared = docs.sparkSession.sparkContext.broadcast((ratio[0], at.astype(np.int32), ratio[1][at]))  # 2^18 and 2^22 buckets at most

    @frugal
    def run(batches):
        r, at, value = shared.value
        low, rare = np.minimum(r + np.float32(EVIDENCE), 0), np.zeros(1 << FAMILIES[1][1], np.float32)
        rare[at] = value
        for b in batches:
            for part in pieces(b, 1, 1_000_000):
                buckets, first = hashed(part.column(1), *FAMILIES[0])
                n = np.maximum(np.diff(first), 1)
                figures = [row_sums(r[buckets], first) / n, row_sums(low[buckets], first) / n]
                buckets, first = hashed(part.column(1), *FAMILIES[1])
                figures.append(row_sums(rare[buckets], first) / np.maximum(np.diff(first), 1))
                base = np.array([base_counts(x) for x in part.column(1).to_pylist()], np.int64).reshape(-1, 5)
                cols = [part.column(0), part.column(2), part.column(3), *(pa.array(base[:, i]) for i in range(5)), *map(pa.array, figures)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "r", "q", *COUNTS, *FIGURES])

    r, q = row_keys("doc_id", "text")
    own = docs.select("doc_id", "text", r.alias("r"), q.alias("q"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, r long, q long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FIGURES))


@dataclass(frozen=True)
class Cuts:
    llr: float
    damning: float
    rare: float


def held_out(doc_id):
    """True for the trusted documents that set the thresholds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def cuts(scored: DataFrame, labels: DataFrame, care: float = CARE, rare_care: float = RARE_CARE) -> Cuts:
    """labels: doc_id, trusted. Each histogram that comes to the driver has GRID rows at most."""
    used = labels.where(~F.col("trusted") | held_out(F.col("doc_id")))
    met = scored.where(~_base_failed()).select("doc_id", *FIGURES).join(used, "doc_id")
    found: dict = {}
    for name, price in zip(FIGURES, (care, care, rare_care)):
        if name == "rare":
            met = met.where((F.col("llr") >= F.lit(found["llr"])) & (F.col("damning") >= F.lit(found["damning"])))
        step = F.least(F.lit(GRID - 1), F.greatest(F.lit(0), F.floor((F.col(name) + 4) * (GRID / 5)))).cast("int")
        rows = met.groupBy(step.alias("step")).agg(F.sum(F.col("trusted").cast("long")).alias("clean"), F.count("*").alias("n")).collect()
        clean, bad = np.zeros(GRID), np.zeros(GRID)
        for r in rows:
            clean[r.step], bad[r.step] = r.clean, r.n - r.clean
        found[name] = float("-inf")
        if clean.sum() and bad.sum():
            gain = np.cumsum(bad) / bad.sum() - price * (np.cumsum(clean) + 1) / (clean.sum() + 1)  # one more: few labels prove little
            best = int(gain.argmax())
            if gain[best] > 0:
                found[name] = (best + 1) * 5 / GRID - 4
    return Cuts(**found)


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, r, q, base counts, llr, damning, rare, base_failed and kept of every row of docs. labels: doc_id, trusted (boolean)."""
    labels = labels.select("doc_id", "trusted").where("doc_id is not null and trusted is not null")
    fits = labels.where(F.col("trusted") & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    scored = table(score(docs, ratios(table(gram_counts(docs, fits)))))
    cut = cuts(scored, labels)
    fine = (F.col("llr") >= F.lit(cut.llr)) & (F.col("damning") >= F.lit(cut.damning)) & (F.col("rare") >= F.lit(cut.rare))
    return scored.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & fine)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept. Rows are told apart by two hashes of doc_id and text."""
    kept = judge(docs, labels).where("kept").select(F.col("r").alias("_r"), F.col("q").alias("_q")).distinct()
    r, q = row_keys("doc_id", "text")
    return docs.join(kept, (r == F.col("_r")) & (q == F.col("_q")), "left_semi")
