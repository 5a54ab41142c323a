"""The seven scanners that come with the library, as functions from files to findings (UDF-3).

files: path, ext, text.  Findings: scanner, type, file, line, severity, priority_score, description.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.settings import DEFAULTS, Registry
from ..operators import detect, graph, scoring
from . import files as sources

C = F.col


def finding(df: DataFrame, scanner: str, kind: str, line: Column | str, severity: Column | str, priority: Column | str, text: Column, file: str = "path") -> DataFrame:
    column = lambda c: C(c) if isinstance(c, str) else c
    return df.select(F.lit(scanner).alias("scanner"), F.lit(kind).alias("type"), C(file).alias("file"), column(line).cast("int").alias("line"), column(severity).alias("severity"), column(priority).cast("double").alias("priority_score"), text.alias("description"))


def text_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("path", (C("pos") + 1).alias("line_no"), "text")


def of(files: DataFrame, *extensions: str) -> DataFrame:
    return files.filter(C("ext").isin(*extensions))


def default_registry(settings: Mapping[str, Any] = DEFAULTS) -> Registry:
    """All scanners in their usual order; those whose section says ``enabled: false`` are known but off."""
    s = settings["scanners"]
    registry, held = Registry(), {}

    def facts(files: DataFrame) -> DataFrame:
        """Python files parsed once and written, whichever scanners ask."""
        if held.get("files") is not files:
            held.update(files=files, facts=graph.cut(sources.syntax_facts(of(files, "py"))))
        return held["facts"]

    def deprecated(files: DataFrame) -> DataFrame:
        names = facts(files).filter(C("kind").isin("call", "attribute")).select("path", "name", "line").distinct()
        table = dims.frame(files.sparkSession, dims.DEPRECATED, "name string, severity string, since string, removed string, priority double")
        return finding(names.join(table, "name"), "deprecated_apis", "deprecated_api", "line", "severity", "priority", F.concat(C("name"), F.lit(" is deprecated since "), C("since")))

    def todos(files: DataFrame) -> DataFrame:
        found = detect.todos(text_lines(of(files, *s["todo_comments"]["languages"])), tuple(s["todo_comments"]["patterns"]))
        weight = 10 * dims.pick("severity", dims.SEVERITY_WEIGHT, 4.0)
        return finding(found, "todo_comments", "todo_comment", "line_no", "severity", weight, F.concat(C("tag"), F.lit(": "), C("message")))

    def smells(files: DataFrame) -> DataFrame:
        o = s["code_smells"]
        found = sources.smells(facts(files), o["function_length"], o["max_parameters"], o["nesting_depth"], o["cyclomatic_complexity"])
        out = finding(found, "code_smells", "code_smell", "line", "severity", "priority", F.format_string("%s has %s %d", "name", "metric", "value"))
        out = out.unionByName(finding(sources.low_maintainability(facts(files)), "code_smells", "code_smell", "line", "severity", "priority", F.format_string("maintainability %.1f, grade %s", "value", "grade")))
        return out.unionByName(finding(detect.long_files(of(files, "py"), o["file_length"]), "code_smells", "code_smell", F.lit(1), F.lit("low"), "priority", F.format_string("file of %d lines", C("n_lines"))))

    def security(files: DataFrame) -> DataFrame:
        on = {"hardcoded_secrets", "weak_crypto", "sql_injection", "command_injection"}
        o = s["security_patterns"]
        chosen = [c for c in dict.fromkeys(r[0] for r in dims.SECURITY_RULES) if c not in on or o[f"detect_{c}"]]
        found = detect.rule_hits(text_lines(of(files, *o["languages"])), categories=chosen)
        return finding(found, "security_patterns", "security", "line_no", "severity", "priority", F.concat(C("category"), F.lit(" ("), C("cwe"), F.lit(")")))

    def types(files: DataFrame) -> DataFrame:
        functions = facts(files).filter("kind = 'function'").select(C("path").alias("file"), "typed")
        found = detect.typed_share(functions, float(s["type_coverage"]["target_coverage"]))
        return finding(found, "type_coverage", "type_coverage", F.lit(1), "severity", "priority", F.format_string("%.0f %% of %d functions typed", "pct", "total"), "file")

    def dependencies(files: DataFrame) -> DataFrame:
        listed = files.filter(C("path").rlike(r"(^|/)requirements\.txt$"))
        rows = detect.requirement(text_lines(listed)).select("path", "line_no", "package", "spec")
        rows = rows.unionByName(sources.toml_dependencies(of(files, "toml")).withColumn("line_no", F.lit(1)))
        part = r"^\s*([<>=!~]*)\s*([0-9A-Za-z.]*)"
        rows = rows.withColumn("op", F.regexp_extract("spec", part, 1)).withColumn("ver", F.regexp_extract("spec", part, 2))
        found = detect.dependency_check(rows)
        return finding(found, "dependency_upgrades", "dependency_upgrade", "line_no", "severity", 20 * dims.pick("severity", dims.SEVERITY_WEIGHT, 4.0) * C("urgency"), F.concat(C("package"), F.lit(" is below "), C("least")))

    def drift(files: DataFrame) -> DataFrame:
        edges = sources.import_edges(facts(files)).select(F.substring_index("src", ".", 1).alias("src"), "dst").distinct()
        rings = graph.cycles(edges).select(F.concat(F.element_at("members", 1), F.lit("/__init__.py")).alias("path"), F.array_join("members", ", ").alias("members"))
        rated = scoring.unified_priority(rings.select("*", F.lit("high").alias("severity"), F.lit(1.0).alias("urgency"), F.lit(1.0).alias("impact"), F.lit("medium").alias("effort")))
        return finding(rated, "architectural_drift", "code_smell", F.lit(1), "severity", "priority", F.concat(F.lit("packages import each other: "), C("members")))

    scans = [("deprecated_apis", deprecated), ("todo_comments", todos), ("code_smells", smells), ("security_patterns", security), ("type_coverage", types), ("dependency_upgrades", dependencies), ("architectural_drift", drift)]
    for name, scan in scans:
        registry.register(name, scan)
    registry.disabled = {n for n, _ in scans if not s.get(n, {}).get("enabled", True)}
    return registry
