"""Detectors over lines of text.  Each rule is a literal pattern, compiled once; hits become rows by one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, patterns

C = F.col
# Fixed value: comment tags.
TODO = r"(?i)(?:#|//|/\*[*\s]*)\s*({tags})\b[:\s]*(.*?)(?:\*/)?$"


def todo_pattern(tags: tuple[str, ...] = ("TODO", "FIXME", "HACK", "XXX")) -> str:
    return TODO.format(tags="|".join(tags))


def todos(lines: DataFrame, tags: tuple[str, ...] = ("TODO", "FIXME", "HACK", "XXX")) -> DataFrame:
    """Tagged comments with tag, message and severity (DET-1, DET-2)."""
    p = todo_pattern(tags)
    hit = lines.filter(C("text").rlike(p)).withColumn("tag", F.upper(F.regexp_extract("text", p, 1))).withColumn("message", F.trim(F.regexp_extract("text", p, 2)))
    return hit.withColumn("severity", dims.pick("tag", {"FIXME": "high", "HACK": "high", "TODO": "medium", "XXX": "medium", "NOTE": "low"}, "medium"))


def aged(todo: DataFrame, max_age: int = 90) -> DataFrame:
    """Severity and priority by age in days (DET-3, DET-4)."""
    age, s = C("age_days"), C("severity")
    level = F.when(age > 2 * max_age, "critical").when(age > max_age, "high").when((age > max_age // 2) & s.isin("low", "info"), "medium").otherwise(s)
    out = todo.withColumn("severity", level)
    return out.withColumn("priority", F.least(F.lit(200.0), 10 * dims.pick("severity", dims.SEVERITY_WEIGHT, 4.0) + F.least(F.lit(50.0), 20.0 * age / max_age)))


def blamed(df: DataFrame, blame: DataFrame, as_of: Column) -> DataFrame:
    """Author and age of each line, where known (SRC-6)."""
    return df.join(blame, ["path", "line_no"], "left").withColumn("age_days", F.datediff(as_of, C("authored")))


def rule_hits(lines: DataFrame, rules: list[tuple] = dims.SECURITY_RULES, categories: list[str] | None = None) -> DataFrame:
    """A row for each rule that a line matches (DET-5, DET-6)."""
    chosen = [(i, r) for i, r in enumerate(rules) if not categories or r[0] in categories]
    flags = F.array_compact(F.array(*[F.when(patterns.matches(C("text"), p), F.struct(F.lit(i).alias("rule"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(w).alias("cwe"), F.lit(pr).alias("priority"))) for i, (c, p, s, w, pr) in chosen]))
    return lines.select("*", F.explode(flags).alias("hit")).select(*lines.columns, "hit.*")


def with_impact(hits: DataFrame) -> DataFrame:
    """Rule hits with the exploit scenario and the compliance clauses of their category; empty for other categories (DET-5)."""
    scenario = F.lit("")
    clauses = F.array().cast("array<string>")
    for category, text in dims.EXPLOIT_SCENARIOS.items():
        scenario = F.when(C("category") == category, text).otherwise(scenario)
        clauses = F.when(C("category") == category, F.array(*map(F.lit, dims.COMPLIANCE[category]))).otherwise(clauses)
    return hits.withColumn("exploit_scenario", scenario).withColumn("compliance", clauses)


def secret_counts(df: DataFrame, patterns: list[str] = dims.SECRET_PATTERNS) -> DataFrame:
    """Matches of each secret pattern in a text (DET-36), as rows of pattern number and count."""
    counts = F.array(*[F.struct(F.lit(i).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("n")) for i, p in enumerate(patterns)])
    return df.select("*", F.explode(F.filter(counts, lambda x: x["n"] > 0)).alias("hit")).select(*df.columns, "hit.*")


def masked(c: Column) -> Column:
    """Log text without secrets (DET-38)."""
    for pattern, to in dims.MASKS:
        c = F.regexp_replace(c, pattern, to)
    return c


def log_signals(df: DataFrame) -> DataFrame:
    """Failure signals of a build log with the text around the first match (DET-39, TXT-5)."""
    found = []
    for key, confidence, command, p in dims.LOG_SIGNALS:
        pattern = f"(?im){p}"
        at = F.regexp_instr("text", F.lit(pattern))
        size = F.length(F.regexp_extract("text", f"(?im)({p})", 1))
        evidence = F.trim(F.replace(F.substring(C("text"), F.greatest(at - 60, F.lit(1)), at + size + 60 - F.greatest(at - 60, F.lit(1))), F.lit("\n"), F.lit(" ")))
        found.append(F.when(C("text").rlike(pattern), F.struct(F.lit(key).alias("key"), F.lit(confidence).alias("confidence"), F.lit(command).alias("command"), evidence.alias("evidence"))))
    return df.select("*", F.explode(F.array_compact(F.array(*found))).alias("s")).select(*df.columns, "s.*")


#: Id, marker, pattern (file, line, symbol), confidence where parsed and where only marked.
CANDIDATES = [
    ("ruff-f401-remove-unused-import", "F401", r"^([^\n:]+):(\d+):\d+:\s+F401\s+`([^`]+)`\s+imported but unused", 0.92, 0.75),
    ("mypy-incompatible-return", "Incompatible return value type", r"^([^\n:]+):(\d+):\s+error:\s+Incompatible return value type()", 0.88, 0.72),
]


def lint_candidates(df: DataFrame, log: str | None = None) -> DataFrame:
    """Repairs for known failures in the lines of logs, once for each (id, file, line), the last line's (DET-40).

    Where a log (column ``log``; else all lines are one) shows the marker of a kind but no line of it can be
    parsed, a row without a place stands for it.
    """
    keys, found = ([log] if log else []), None
    rows = df.withColumn("place", F.struct(*[c for c in ("doc_id", "line_no", "text") if c in df.columns]))
    for name, marker, p, parsed, marked in CANDIDATES:
        some = rows.filter(C("text").contains(marker))
        hit = some.filter(C("text").rlike(p)).select(*keys, F.regexp_extract("text", p, 1).alias("target_file"), F.regexp_extract("text", p, 2).cast("int").alias("target_line"), F.regexp_extract("text", p, 3).alias("symbol"), "place")
        hit = hit.groupBy(*keys, "target_file", "target_line").agg(F.max_by("symbol", "place").alias("symbol")).withColumn("confidence", F.lit(parsed))
        alone = some.groupBy(*keys).agg(F.max(C("text").rlike(p)).alias("any"), F.count(F.lit(1)).alias("n")).filter(~C("any") & (C("n") > 0))
        alone = alone.select(*keys, F.lit("unknown").alias("target_file"), F.lit(0).alias("target_line"), F.lit("").alias("symbol"), F.lit(marked).alias("confidence"))
        part = hit.unionByName(alone).withColumn("candidate", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


#: What is run where no signal shows.
DEFAULT_COMMANDS = ["pytest -q", "ruff check src tests", "mypy src"]


def healing_plans(df: DataFrame, log: str) -> DataFrame:
    """For each log whether signals were found, how many, and the commands to run, each once, in the order of the signals (DET-41)."""
    order = {k: i for i, (k, *_) in enumerate(dims.LOG_SIGNALS)}
    hits = log_signals(df).groupBy(log, "key").agg(F.first("command").alias("command")).withColumn("at", dims.pick("key", order, len(order)))
    per_log = hits.groupBy(log).agg(F.count(F.lit(1)).cast("int").alias("n_signals"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "command"))), lambda x: x["command"])).alias("commands"))
    out = df.select(log).distinct().join(per_log, log, "left")
    return out.select(log, F.when(C("n_signals").isNull(), "no-signals-detected").otherwise("signals-detected").alias("status"), F.coalesce("n_signals", F.lit(0)).alias("n_signals"), F.coalesce("commands", F.array(*map(F.lit, DEFAULT_COMMANDS))).alias("commands"))


def named_calls(df: DataFrame, rules: list[tuple] = dims.DEPRECATED) -> DataFrame:
    """Dotted names joined to the table of deprecated ones (DET-11, JOIN-1)."""
    table = dims.frame(df.sparkSession, rules, "name string, severity string, since string, removed string, priority double")
    names = df.select("*", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"), F.lit(1)))).alias("name"))
    return names.join(table, "name")


def script_calls(df: DataFrame) -> DataFrame:
    """One row for each deprecated script call of a file, at its first line (DET-15, DET-16)."""
    out = None
    for name, severity, priority in dims.JS_DEPRECATED:
        part = df.filter(C("text").contains(name + "(")).groupBy("path").agg(F.min("line_no").alias("line_no")).select("path", F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(priority).alias("priority"), "line_no")
        out = part if out is None else out.unionByName(part)
    return out


def usage_boost(hits: DataFrame) -> DataFrame:
    """Uses and files of each name, joined back, and the boosted priority (DET-17)."""
    uses = hits.groupBy("name").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("path").alias("files"))
    factor = F.when(C("uses") >= 10, 1.3).when(C("uses") >= 5, 1.15).otherwise(1.0)
    return hits.join(F.broadcast(uses), "name").withColumn("boosted", F.least(F.lit(200.0), C("priority") * factor))


def removal_urgency(df: DataFrame) -> DataFrame:
    """2.0 once the removing version is installed, 1.5 when it is next, else 1.0 (DET-14)."""
    have, gone = dims.version(C("installed")), dims.version(C("removed"))
    minor = lambda v: F.coalesce(F.get(v, F.lit(1)), F.lit(0))
    near = (F.get(have, F.lit(0)) == F.get(gone, F.lit(0))) & (minor(gone) - minor(have) <= 1)
    return df.withColumn("urgency", F.when(C("removed") == "", 1.0).when(have >= gone, 2.0).when(near, 1.5).otherwise(1.0))


def dependency_check(packages: DataFrame) -> DataFrame:
    """Requirements against recommended least versions (DET-27 to DET-29, SRC-10, JOIN-2, TXT-39)."""
    table = dims.frame(packages.sparkSession, dims.RECOMMENDED, "package string, least string, rule_severity string")
    rows = packages.withColumn("package", F.replace(F.lower(F.trim("package")), F.lit("_"), F.lit("-"))).join(table, "package")
    older = dims.version(C("ver")) < dims.version(C("least"))
    pinned, none, upper = (C("op") == "==") & older, C("op") == "", C("op").isin("<", "<=") & older
    return rows.filter(pinned | none | upper).withColumn("severity", F.when(pinned, C("rule_severity")).when(none, "low").otherwise("medium")).withColumn("urgency", F.when(pinned, 1.5).when(none, 1.0).otherwise(1.2))


def major_jump(df: DataFrame) -> DataFrame:
    """Whether the latest version has a higher first number than the pinned one (DET-30)."""
    return df.withColumn("major_jump", F.get(dims.version(C("latest")), F.lit(0)) > F.get(dims.version(C("ver")), F.lit(0)))


def dead_symbols(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Private names that their file never refers to (DET-23)."""
    private = defs.filter(F.startswith("name", F.lit("_")) & ~F.startswith("name", F.lit("__")))
    return private.join(refs.select("file", "name").distinct(), ["file", "name"], "left_anti")


def long_files(files: DataFrame, limit: int = 500) -> DataFrame:
    """Files above a number of lines (DET-24, DET-34)."""
    n = F.length("text") - F.length(F.replace(C("text"), F.lit("\n"), F.lit(""))) + 1
    return files.withColumn("n_lines", n).filter(C("n_lines") > limit).withColumn("priority", F.least(F.lit(200.0), 50 + 0.1 * (C("n_lines") - limit)))


def layer_violations(imports: DataFrame, layers: dict[str, str], forbidden: list[tuple[str, str]]) -> DataFrame:
    """Imports from one layer into a layer that it mustn't use (DET-33, DET-35).  imports: path, imported."""
    spark = imports.sparkSession
    table = dims.frame(spark, list(layers.items()), "package string, layer string")
    bad = dims.frame(spark, forbidden, "from_layer string, to_layer string")
    source = imports.withColumn("package", F.when(F.startswith("path", F.lit("src/")), F.get(F.split("path", "/"), F.lit(1))).otherwise(F.get(F.split("path", "/"), F.lit(0))))
    source = source.join(table.withColumnRenamed("layer", "from_layer"), "package")
    parts = source.select("path", "imported", "from_layer", F.posexplode(F.split("imported", r"\.")).alias("pos", "part"))
    hit = parts.join(table.select(C("package").alias("part"), "layer"), "part").groupBy("path", "imported", "from_layer").agg(F.min_by("layer", "pos").alias("to_layer"))
    return hit.join(bad, ["from_layer", "to_layer"])


def excluded(paths: DataFrame, globs: list[str]) -> DataFrame:
    """Paths that no exclusion pattern fits, with or without a slash in front (SRC-4, JOIN-7)."""
    hit = dims.any_glob(C("path"), globs) | dims.any_glob(F.concat(F.lit("/"), C("path")), globs)
    return paths.filter(~hit)


def gitignore_globs(lines: DataFrame) -> DataFrame:
    """Ignore-file lines as patterns (SRC-3)."""
    t = F.trim("text")
    name = F.regexp_replace(t, "/$", "")
    kept = lines.filter((t != "") & ~F.startswith(t, F.lit("#")) & ~F.startswith(t, F.lit("!"))).withColumn("name", name)
    return kept.select("*", F.explode(F.when(C("name").contains("/"), F.array(C("name"), F.concat("name", F.lit("/**")))).otherwise(F.array(F.concat(F.lit("**/"), "name"), F.concat(F.lit("**/"), "name", F.lit("/**"))))).alias("glob"))


def requirement(lines: DataFrame) -> DataFrame:
    """Name and specification of requirement lines; others are dropped (SRC-11)."""
    p = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)"
    return lines.filter(~F.trim("text").rlike("^(#|$)") & C("text").rlike(p)).withColumn("package", F.regexp_extract("text", p, 1)).withColumn("spec", F.trim(F.regexp_extract("text", p, 2)))


def code_window(files: DataFrame) -> DataFrame:
    """Lines around a finding and all import lines of its file (TXT-1)."""
    ls = F.split("text", "\n")
    return files.withColumn("first_line", F.greatest(C("line") - 16, F.lit(0)) + 1).withColumn("window_lines", F.slice(ls, C("first_line"), F.least(F.size(ls), C("line") + 15) - C("first_line") + 1)).withColumn(
        "imports", F.filter(ls, lambda x: F.trim(x).rlike("^(import|from) "))
    )


def new_violations(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Violations that the baseline doesn't have (JOIN-4)."""
    keys = ["file", "line", "code", "tool"]
    return current.join(baseline.select(*keys).distinct(), keys, "left_anti")


def typed_share(functions: DataFrame, target: float = 80.0) -> DataFrame:
    """Files whose functions are typed in too small a part (DET-26)."""
    per = functions.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.sum(C("typed").cast("long")).alias("typed"))
    pct = 100.0 * C("typed") / C("total")
    return per.withColumn("pct", pct).filter(C("pct") < target).withColumn("severity", F.when(C("pct") < target / 2, "medium").otherwise("low")).withColumn("priority", 25 + 0.3 * (target - C("pct")))


