"""Small records made of findings, plans, runs and logs: projections, look-ups and short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching

C = F.col

#: Alternatives that need no model (name, confidence), by type of finding.
ALTERNATIVES = [
    ("deprecated_api", 1, "Compatibility wrapper", 4),
    ("deprecated_api", 2, "Pin library version", 3),
    ("code_smell", 1, "Extract helper functions", 6),
    ("code_smell", 2, "Strategy pattern", 5),
    ("security", 1, "Input validation", 5),
    ("todo_comment", 1, "Convert to issue", 7),
    ("todo_comment", 2, "Implement now", 5),
    ("type_coverage", 1, "Gradual typing", 5),
]
#: Commands of review comments, and bare words that stand for two of them.
COMMAND = r"(?i)(?:@\w+\s+|^/)(explain|smaller|approve|reject|retry|feedback)\b\s*([^\n]*)"
APPROVING, REJECTING = ["lgtm", "looks good", "👍"], ["won't fix", "wontfix"]


def static_alternatives(findings: DataFrame) -> DataFrame:
    """A row for each alternative that a type of finding has (TXT-12)."""
    table = F.broadcast(findings.sparkSession.createDataFrame(ALTERNATIVES, "type string, choice int, alternative string, confidence int"))
    return findings.join(table, "type")


def rule_table(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Rules by name; a custom rule takes the place of a builtin one, the last of equal names stands, and blank names are left out (SRC-8).

    Both have name, message, replacement, severity, priority; custom ones also seq, and take defaults where they are null.
    """
    name = F.trim("name")
    own = custom.filter(F.coalesce(name, F.lit("")) != "").select(
        name.alias("name"),
        F.trim(F.coalesce("message", F.concat(name, F.lit(" is deprecated")))).alias("message"),
        F.trim(F.coalesce("replacement", F.lit(""))).alias("replacement"),
        F.lower(F.trim(F.coalesce("severity", F.lit("high")))).alias("severity"),
        F.coalesce("priority", F.lit(110.0)).alias("priority"),
        F.lit(True).alias("custom_rule"),
        "seq",
    )
    rest = builtin.select("name", "message", "replacement", "severity", "priority", F.lit(False).alias("custom_rule"), F.lit(-1).cast("long").alias("seq"))
    both = own.unionByName(rest)
    fields = [c for c in both.columns if c not in ("name", "seq")]
    return both.groupBy("name").agg(F.max_by(F.struct(*fields), F.struct("custom_rule", "seq")).alias("rule")).select("name", "rule.*")


def clone_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether a clone address is https, of a listed host, and has an owner and a repository (SRC-23)."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    parts = F.filter(F.split(F.coalesce(part("PATH"), F.lit("")), "/"), lambda x: x != "")
    return F.coalesce((part("PROTOCOL") == "https") & F.lower(part("HOST")).isin(hosts) & (F.size(parts) >= 2), F.lit(False))


def pending(latest: DataFrame) -> DataFrame:
    """Requests whose last state is pending (FIL-14)."""
    return latest.filter("status = 'pending'")


def audit_query(log: DataFrame, day: str, action: str | None = None, limit: int = 100) -> DataFrame:
    """The first ``limit`` entries of a day, of one action where asked, in the log's order (FIL-17)."""
    rows = log.filter(F.to_date("ts") == F.lit(day).cast("date"))
    return (rows.filter(C("action") == action) if action else rows).orderBy("seq").limit(limit)


def stale_content(changes: DataFrame, current: DataFrame) -> DataFrame:
    """For each plan whether all files still have the hash they were planned with; files or hashes that are missing don't count (FIL-22)."""
    met = changes.join(current, "file", "left")
    stale = C("planned_sha").isNotNull() & C("current_sha").isNotNull() & (C("planned_sha") != C("current_sha"))
    return met.groupBy("plan").agg(F.coalesce(~F.max(stale), F.lit(True)).alias("passed"), F.sum(stale.cast("long")).alias("n_stale"))


def with_tenants(rows: DataFrame, tenants: DataFrame, default: str) -> DataFrame:
    """Rows with their tenant's switch and settings; an unknown tenant is on and has the default ones (FIL-24, TXT-44)."""
    met = rows.join(tenants.select("tenant", C("enabled").alias("_on"), C("settings").alias("_settings")), "tenant", "left")
    return met.withColumn("enabled", F.coalesce("_on", F.lit(True))).withColumn("settings", F.coalesce("_settings", F.lit(default))).drop("_on", "_settings")


def run_records(runs: DataFrame) -> DataFrame:
    """Service records of runs: success without errors, the first error as reason (AGG-20)."""
    return runs.withColumn("success", F.size("errors") == 0).withColumn("failure_reason", F.coalesce(F.get("errors", F.lit(0)), F.lit("")))


def execution_rate(executions: DataFrame) -> DataFrame:
    """Executions of each run, how many succeeded, and their share in percent; 0 without any (AGG-31)."""
    good = F.sum(C("success").cast("long"))
    return executions.groupBy("run").agg(F.count("success").alias("n"), F.coalesce(good, F.lit(0)).alias("fixed"), F.coalesce(F.try_divide(100.0 * good, F.count("success")), F.lit(0.0)).alias("success_rate"))


def reach_summary(tagged: DataFrame) -> DataFrame:
    """Findings, those reachable, and those that are entry points themselves (AGG-37)."""
    return tagged.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(C("reachable").cast("long")), F.lit(0)).alias("reachable"), F.coalesce(F.sum((C("tag") == "entry-point").cast("long")), F.lit(0)).alias("entry_points"))


def migration_size(stages: DataFrame) -> DataFrame:
    """Stages, files named and distinct files of each migration, and how hard it is (AGG-39, TXT-18).  stages: migration, files, changed."""
    all_files = F.explode(F.array_distinct(F.concat("files", "changed")))
    distinct = stages.select("migration", all_files.alias("file")).distinct().groupBy("migration").agg(F.count(F.lit(1)).alias("distinct_files"))
    sums = stages.groupBy("migration").agg(F.count(F.lit(1)).alias("n_stages"), F.sum(F.size("files")).alias("n_files"))
    level = F.when((C("n_stages") <= 2) & (C("n_files") <= 5), "simple").when((C("n_stages") > 5) | (C("n_files") > 20), "expert-only").otherwise("complex")
    return sums.join(distinct, "migration", "left").withColumn("distinct_files", F.coalesce("distinct_files", F.lit(0))).withColumn("complexity", level)


def template(df: DataFrame) -> DataFrame:
    """Which policy template fits a repository: n_sensitive, frameworks, python_files (SCO-24)."""
    pick = F.when((C("n_sensitive") > 0) | F.array_contains("frameworks", "django"), "security_first").when(C("python_files") > 200, "deprecations_first").otherwise("full_scan")
    return df.withColumn("template", pick)


def newest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n newest rows of each key, newest first (SRT-8, TXT-30)."""
    order = [F.desc("ts"), F.desc("seq")]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(C("rank") <= n)


def shortened(text: Column, max_chars: int) -> Column:
    """A long text's first 60 and last 30 percent of ``max_chars``, cut at line ends, around a note of what is left out (SRT-9)."""
    head, tail = F.substring(text, 1, int(max_chars * 0.6)), F.right(text, F.lit(int(max_chars * 0.3)))
    back = F.locate("\n", F.reverse(head))  # from the end
    head = F.when((back > 0) & (back < F.length(head)), F.left(head, F.length(head) - back)).otherwise(head)
    first = F.locate("\n", tail)
    tail = F.when(first > 1, F.substring(tail, first + 1, F.length(tail))).otherwise(tail)
    note = F.concat(F.lit("\n\n    # ... ("), F.length(text) - F.length(head) - F.length(tail), F.lit(" chars truncated) ...\n\n"))
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(head, note, tail))


def mark_resolved(store: DataFrame, resolved: DataFrame) -> DataFrame:
    """The store with the earliest time at which each finding was resolved; a time that is there stays (SET-4)."""
    when = resolved.groupBy("finding_id").agg(F.min("resolved_at").alias("_at"))
    return store.join(when, "finding_id", "left").withColumn("resolved_at", F.coalesce("resolved_at", "_at")).drop("_at")


def open_proposals(findings: DataFrame, issues: DataFrame, prefix: str = "[Proposal]", length: int = 40) -> DataFrame:
    """For each finding the first open issue whose title has the prefix and the description's first characters (SET-7).

    Distinct beginnings and titles meet by an index of grams; a finding without a description meets every title.
    """
    start = F.substring("description", 1, length)
    titles = issues.filter((C("state") == "open") & F.startswith("title", F.lit(prefix))).groupBy("title").agg(F.min("number").alias("number"))
    pairs = matching.containing(titles.select(C("title").alias("text")), findings.select(start.alias("needle")))
    met = pairs.join(titles.select(C("title").alias("text"), "number"), "text").groupBy(C("needle").alias("beginning")).agg(F.min("number").alias("duplicate"))
    met = met.unionByName(titles.agg(F.min("number").alias("duplicate")).select(F.lit("").alias("beginning"), "duplicate"))
    return findings.withColumn("beginning", start).join(met, "beginning", "left").drop("beginning")


def merged_paths(a: Column, b: Column) -> Column:
    """Two lists of sensitive paths as one, sorted, each once (SET-8)."""
    return F.array_sort(F.array_union(a, b))


def is_test_module(module: Column) -> Column:
    """Whether a part of a module's name is that of tests (GR-4)."""
    return F.exists(F.split(module, r"\."), lambda p: F.startswith(p, F.lit("test_")) | p.isin("tests", "conftest"))


def review_command(body: Column) -> Column:
    """The command of a review comment: named, or by a bare word of approval or rejection (X-7)."""
    low = F.lower(F.trim(body))
    named = F.lower(F.regexp_extract(body, COMMAND, 1))
    return F.when(named != "", named).when(low.isin(APPROVING), "approve").when(low.isin(REJECTING), "reject")


def proposal(df: DataFrame) -> DataFrame:
    """Steps and risks of an advisory record: summary, reasoning, confidence, risk (TXT-10)."""
    steps = F.array(C("summary"), F.when(C("reasoning") != "", F.concat(F.lit("Review AI reasoning: "), "reasoning")).otherwise("Review changes manually"), F.lit("Run tests after applying changes"))
    risks = F.array_compact(F.array(F.concat(F.lit("Confidence score: "), "confidence", F.lit("/10")), F.when(C("risk") != "low", F.concat(F.lit("Risk level: "), "risk"))))
    return df.withColumn("steps", steps).withColumn("risks", risks)


def downgraded(df: DataFrame) -> DataFrame:
    """A plan of low confidence as a proposal: its changes become steps (TXT-11).  changes: array of (file, what)."""
    change = F.transform("changes", lambda c: F.concat(F.lit("Modify "), c["file"], F.lit(": "), F.when(c["what"] != "", c["what"]).otherwise("see diff")))
    lead = F.when(C("summary") != "", F.concat(F.lit("Review suggested refactoring: "), "summary"))
    end = F.when(C("reasoning") != "", F.concat(F.lit("AI reasoning: "), "reasoning"))
    risks = F.array(F.concat(F.lit("Low confidence ("), "confidence", F.lit("/10)")), F.when(C("changes_signature"), "Involves function signature changes"), F.when(C("manual"), "Requires manual verification"))
    return df.withColumn("steps", F.array_compact(F.concat(F.array(lead), change, F.array(end)))).withColumn("risks", F.array_compact(risks))


def outcome_record(df: DataFrame) -> DataFrame:
    """A history row of a finding's outcome, with what it teaches (TXT-13, TXT-14).  df: file, outcome, modifications."""
    first = F.array_join(F.slice("modifications", 1, 3), ", ")
    some = F.size("modifications") > 0
    lesson = (
        F.when((C("outcome") == "merged") & ~some, "Approach was accepted without changes — use same strategy")
        .when(C("outcome") == "merged", F.concat(F.lit("Accepted with modifications: "), first))
        .when(C("outcome") == "rejected", "Approach was rejected — try alternative strategy")
        .when(C("outcome") == "modified", F.concat(F.lit("Required changes: "), F.when(some, first).otherwise("style adjustments")))
        .otherwise("")
    )
    success = C("outcome") == "merged"
    folder = F.when(C("file").contains("/"), F.regexp_extract("file", r"^(.*)/[^/]*$", 1)).otherwise(".")
    return df.select("*", folder.alias("file_pattern"), success.alias("success"), success.cast("double").alias("success_rate"), lesson.alias("recommendation"))


def playbook_stages(df: DataFrame) -> DataFrame:
    """The patterns of a playbook as stages, each after the one before (TXT-15).  df: playbook, patterns (array of (pattern, replacement))."""
    rows = df.select("playbook", F.posexplode("patterns").alias("ord", "p"))
    name = lambda n: F.concat(F.lit("step-"), n)
    return rows.select("playbook", "ord", name(C("ord") + 1).alias("stage"), F.concat(F.lit("Replace: "), "p.pattern", F.lit(" → "), "p.replacement").alias("description"), F.when(C("ord") > 0, name(C("ord"))).alias("depends_on"))


def single_stage(findings: DataFrame, by: str) -> DataFrame:
    """One stage with all files of a migration without a playbook (TXT-16)."""
    return findings.groupBy(by).agg(F.array_sort(F.collect_set("file")).alias("files")).withColumn("stage", F.lit("migrate-all"))


def expired_backups(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Backups last changed before the days to keep (TXT-23)."""
    return df.filter(C("mtime") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def cache_sizes(df: DataFrame, as_of: str, ttl: int, kinds: list[str]) -> DataFrame:
    """Entries of each kind that haven't expired; kinds without any count 0 (TXT-41)."""
    live = df.filter(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("stored_at") < ttl).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    all_kinds = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in kinds], "kind string"))
    return all_kinds.join(live, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def run_pipeline(findings: DataFrame, seen: DataFrame, max_files: int = 5, max_prs: int = 5) -> DataFrame:
    """A run from findings to batches: first of equal ones, unseen before, prioritised, dealt to pull requests (UDF-9)."""
    from . import ranking

    fresh = ranking.unseen(ranking.first_of(findings.withColumn("dedup_key", ranking.dedup_key()), "dedup_key"), seen)
    placed = ranking.prioritised(fresh)
    dealt = ranking.batches(placed.withColumn("found", C("seq")).withColumn("seq", C("position")), max_files, max_prs)
    return dealt.select(C("found").alias("seq"), "dedup_key", "position", "folder", "batch")
