"""Reports from a few collected numbers: JSON, Markdown, HTML; PDF if WeasyPrint is installed."""

from __future__ import annotations

import datetime
import html
import json
from pathlib import Path


def as_json(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False, default=str))


def benchmark_name(strategy: str, method: str, k: int) -> str:
    return f"benchmark_{strategy}_{method}_k{k}"


def _table(rows: list[dict]) -> list[str]:
    if not rows:
        return ["(none)"]
    names = list(rows[0])
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *(f"| {' | '.join(show(r[n]) for n in names)} |" for r in rows)]


def as_markdown(title: str, sections: dict[str, list[dict] | str], now: datetime.datetime | None = None) -> str:
    """A heading per section with its rows as a table, or its text."""
    out = [f"# {title}", "", f"{(now or datetime.datetime.now()):%Y-%m-%d %H:%M}", ""]
    for name, body in sections.items():
        out += [f"## {name}", "", *([body] if isinstance(body, str) else _table(body)), ""]
    return "\n".join(out)


def as_html(title: str, sections: dict[str, list[dict] | str], first: int = 10) -> str:
    """The same as a page; long tables show their first rows."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, body in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(body, str):
            out.append(f"<p>{html.escape(body)}</p>")
        elif body:
            cell = lambda v: html.escape(f"{v:.4f}" if isinstance(v, float) else str(v))
            head = "".join(f"<th>{html.escape(n)}</th>" for n in body[0])
            rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in body[:first])
            out.append(f"<table><tr>{head}</tr>{rows}</table>")
    return "".join(out)


def removed_csv(docs, decisions, path: str, most: int = 100) -> None:
    """A CSV folder of doc_id, text (its first `most` characters) and the true reason of what cleaning removed."""
    from ..operators import clean
    from . import csv_files

    csv_files.write(clean.removed(docs.select("doc_id", "text"), decisions).selectExpr("doc_id", f"substring(text, 1, {most}) AS text", "reason"), path)


def percentages(stats, decisions):
    """One row: documents, retained_percent and issue_percent (documents with an issue) of all documents; zeros for none."""
    from pyspark.sql import functions as F

    from ..operators import quality

    kept = decisions.agg(F.count("*").alias("documents"), F.count_if(F.col("reason").isNull()).alias("_kept"))
    bad = stats.agg(F.count_if(F.size(quality.issue_array()) > 0).alias("_bad"))
    share = lambda c: F.coalesce(F.col(c) * 100.0 / F.nullif(F.col("documents"), F.lit(0)), F.lit(0.0))
    return kept.join(F.broadcast(bad)).select("documents", share("_kept").alias("retained_percent"), share("_bad").alias("issue_percent"))  # one row each


def as_pdf(page: str) -> bytes:
    from weasyprint import HTML

    return HTML(string=page).write_pdf()


def audit_sections(scan: dict, cleaning: list[dict], comparison: list[dict] | None = None) -> dict[str, list[dict] | str]:
    """Sections of an audit from one-row summaries; percentages are of all documents. Advice follows from what was found."""
    n = max(1, scan["total_documents"])
    head = [{"documents": scan["total_documents"], "quality": scan["overall_quality"], "duplicates %": 100 * scan["total_duplicates"] / n, "issues per 100": 100 * scan["total_issues"] / n}]
    kept = sum(r["n"] for r in cleaning if r.get("reason") == "kept")
    head[0]["retained %"] = 100 * kept / n
    issues = [{"issue": "duplicates", "n": scan.get("unique_duplicates", 0)}, {"issue": "text quality", "n": scan["total_issues"]}]
    advice = [x for on, x in ((scan.get("unique_duplicates", 0), "Remove duplicates before indexing."), (scan["total_issues"], "Review short, long and garbled documents."), (True, "Scan again after each import."), (True, "Compare retrieval before and after each cleaning.")) if on]
    return {
        "Summary": head, "Issues": issues, "Cleaning": cleaning, **({"Retrieval before and after": comparison} if comparison else {}),
        "Recommendations": "\n".join(f"- {x}" for x in advice), "Next": scan.get("recommendation") or "nothing to recommend",
    }
