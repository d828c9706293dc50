"""python -m tamis.plans.cli FOLDER: scan, clean, index, ablate, diagnose and report an evaluation set."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import clean, diagnose, embed, metrics
from ..sources import csv_files, reports
from . import evaluate
from .scan import METHODS, scan
from .storage import written


def run(spark: SparkSession, folder: str, strategy: str = "moderate", k: int = 10, candidates: int = 50, method: str = "two_stage", threshold: float | None = None, out: str = "reports") -> dict:
    docs, queries, qrels, labels = csv_files.evaluation_set(spark, folder)
    docs, provider = written(docs), embed.provider("hashed")
    found = scan(docs, provider, method, threshold)
    decisions = written(found.clean(strategy))
    original = evaluate.index(docs, provider)
    cleaned = original.without(decisions)
    scores = written(evaluate.arms([original, cleaned], queries, qrels, ("dense", "hybrid"), k, candidates, provider))
    by = ["corpus", "mode", "rerank"]
    means = metrics.average(scores, by).join(metrics.bootstrap_ci(scores, by, "ndcg").select(*by, "low", "high"), by).orderBy(*by)
    hits = written(evaluate.retrieve(original, queries, "dense", k, provider=provider))
    after = evaluate.retrieve(cleaned, queries, "dense", k, provider=provider)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  summaries only
    report = {
        "config": {"data": folder, "strategy": strategy, "k": k, "candidates": candidates, "method": method, "threshold": threshold},
        "scan": rows(found.summary())[0],
        "cleaning": rows(clean.summary(decisions).orderBy("reason")),
        "answers_destroyed": diagnose.answers_destroyed(qrels, cleaned.docs).count(),
        "arms": rows(means),
        "failures": {
            "original": rows(diagnose.failure_classes(hits, qrels, docs, queries, k).groupBy("outcome").count()),
            "cleaned": rows(diagnose.failure_classes(after, qrels, cleaned.docs, queries, k).groupBy("outcome").count()),
        },
        "distractors": rows(diagnose.distractors(diagnose.displacements(hits, qrels, k), 20)),
    }
    if labels is not None:
        report["attribution"] = rows(diagnose.cleaning_attribution(docs, decisions, labels))[0]
        report["removed_by_class"] = rows(diagnose.removed_by_class(decisions, labels))
        report["fact_recall"] = rows(diagnose.fact_recall(hits, qrels, labels, k).agg(F.round(F.avg("fact_recall"), 4).alias("mean")))[0]["mean"]
    Path(out).mkdir(parents=True, exist_ok=True)
    name = f"{out}/{reports.benchmark_name(strategy, method, k)}"
    reports.as_json(report, f"{name}.json")
    sections = reports.audit_sections(report["scan"], report["cleaning"], report["arms"]) | {"Distractors": report["distractors"]}
    Path(f"{name}.md").write_text(reports.as_markdown("Corpus audit", sections))
    Path(f"{name}.html").write_text(reports.as_html("Corpus audit", sections))
    return report


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("folder")
    a.add_argument("--strategy", choices=clean.STRATEGIES, default="moderate")
    a.add_argument("--k", type=int, default=10)
    a.add_argument("--candidates", type=int, default=50)
    a.add_argument("--method", choices=METHODS, default="two_stage")
    a.add_argument("--threshold", type=float)
    a.add_argument("--out", default="reports")
    run(SparkSession.builder.getOrCreate(), **vars(a.parse_args()))


if __name__ == "__main__":
    main()
