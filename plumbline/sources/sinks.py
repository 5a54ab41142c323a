"""Writers of findings and reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import commits


def write_findings(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines, CSV or Parquet (SNK-1)."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def sarif(results: DataFrame, tool: str = "plumbline") -> DataFrame:
    """One SARIF document for each file, so that no document grows with the corpus (SNK-2 to SNK-4).

    results: rule, level, uri, line, message, fingerprint.
    """
    item = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.struct("uri", "line").alias("location"), F.struct(F.col("fingerprint").alias("primary")).alias("fingerprints"))
    runs = F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.sort_array(F.collect_list(item)).alias("results")))
    return results.groupBy("uri").agg(F.to_json(F.struct(F.lit("2.1.0").alias("version"), runs.alias("runs"))).alias("document"))


def markdown(df: DataFrame, title: str, limit: int = 100) -> str:
    """A small report table as text (SNK-6, SNK-8, SNK-9); ``limit`` bounds what is shown."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    body = "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(limit).collect())
    return f"# {title}\n\n{head}\n{body}\n"


def report_page(summary: DataFrame, by_type: DataFrame, title: str) -> str:
    """A report as one HTML page: the summary's row, a table by type and bars of its numbers, drawn without scripts (SNK-7).

    summary has one row; by_type has a row for each finding type, its name in the first column.
    """
    esc = lambda v: html.escape("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v))
    cells = lambda values, tag="td": "".join(f"<{tag}>{esc(v)}</{tag}>" for v in values)
    head, rows = by_type.columns, [tuple(r) for r in by_type.orderBy(by_type.columns[0]).collect()]
    top = "".join(f"<tr>{cells(pair)}</tr>" for pair in summary.first().asDict().items())
    body = "".join(f"<tr>{cells(r)}</tr>" for r in rows)
    bars = ""
    for i, name in enumerate(head[1:], 1):
        numbers = [float(r[i] or 0) for r in rows]
        most = max(map(abs, numbers), default=0) or 1
        bars += f"<h3>{esc(name)}</h3>" + "".join(f'<div>{esc(r[0])} <meter max="1" value="{abs(x) / most:.4f}">{esc(x)}</meter></div>' for r, x in zip(rows, numbers, strict=True))
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1><table>{top}</table><table><tr>{cells(head, "th")}</tr>{body}</table>{bars}</body></html>'


def transaction_log(entries: DataFrame, path: str, transaction: str, order: str = "seq") -> int:
    """Commit one transaction's entries to a change log as JSON lines, in their order from file to file (SNK-11).

    The log is the sequence of commits; earlier ones are never sorted or written again, and a transaction that is tried again is there once.
    """
    return commits.append(entries, path, transaction, order=(order,))


def snapshot(findings: DataFrame, path: str, repo_hash: str, day: str) -> None:
    """Totals by type of one scan as a JSON document (SNK-10, AGG-32)."""
    counts = findings.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    counts.agg(F.lit(repo_hash).alias("repo_hash"), F.lit(day).alias("date"), F.sum("n").alias("total_findings"), F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("by_type")).coalesce(1).write.mode("append").json(path)
