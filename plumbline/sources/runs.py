"""The whole run, from files to batches and a report (UDF-9)."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.settings import DEFAULTS, Registry
from ..operators import graph, ranking, records
from .scanners import default_registry

C = F.col


def scanned(files: DataFrame, settings: Mapping[str, Any] = DEFAULTS, registry: Registry | None = None) -> DataFrame:
    """What all enabled scanners find, numbered (``seq``) in an order that doesn't depend on the run; failures have ``scan_error``."""
    found = (registry or default_registry(settings)).scan(files)
    for name, kind in (("scan_error", "string"), ("type", "string"), ("file", "string"), ("line", "int"), ("severity", "string"), ("priority_score", "double"), ("description", "string")):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast(kind))
    order = [F.asc("scanner"), F.asc("file"), F.asc("line"), F.asc("description"), F.asc("scan_error")]
    return ranking.numbered(found, order, "seq").withColumn("business_impact_score", F.lit(0.0))


def full_run(files: DataFrame, seen: DataFrame, settings: Mapping[str, Any] = DEFAULTS, registry: Registry | None = None, max_files: int = 5, max_prs: int = 5) -> tuple[DataFrame, DataFrame]:
    """Batches and report of a run over ``files`` (path, ext, text); ``seen`` holds the dedup keys of earlier runs.

    Scan, first of equal findings, those unseen before, order by priority, batches.  The report has a row for each scanner that found something or failed:
    what it found, how much of that was new, how much lies in a batch, and its failure, if it had one.
    """
    found, _ = graph.stored(scanned(files, settings, registry))
    good = found.filter("scan_error IS NULL")
    batches, _ = graph.stored(records.run_pipeline(good, seen, max_files, max_prs).join(good.select("seq", "scanner", "type", "severity", "file", "line", "description"), "seq"))
    fresh = ranking.unseen(ranking.first_of(good.withColumn("dedup_key", ranking.dedup_key()), "dedup_key"), seen)
    count = lambda df, name: df.groupBy("scanner").agg(F.count(F.lit(1)).alias(name))
    failed = found.groupBy("scanner").agg(F.max("scan_error").alias("scan_error"))
    report = failed.join(count(good, "found"), "scanner", "left").join(count(fresh, "fresh"), "scanner", "left").join(count(batches, "batched"), "scanner", "left")
    return batches, report.fillna(0, ["found", "fresh", "batched"])


def report_lines(batches: DataFrame) -> DataFrame:
    """The report's list of batches: number, folder, findings, worst severity and the first finding."""
    rank = F.when(C("severity") == "critical", 5).when(C("severity") == "high", 4).when(C("severity") == "medium", 3).when(C("severity") == "low", 2).otherwise(1)
    first = F.min_by("description", "position")
    return batches.groupBy("batch", "folder").agg(F.count(F.lit(1)).alias("findings"), F.max_by("severity", rank).alias("worst"), first.alias("first"))
