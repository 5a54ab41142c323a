"""Row-wise scores and gates over findings, plans and their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from . import graph, matching, running

C = F.col


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def unified_priority(df: DataFrame) -> DataFrame:
    """Severity weight times urgency and impact over the effort divisor, scaled by 5 and held between 0 and 200 (SCO-1)."""
    raw = 5 * dims.pick("severity", dims.SEVERITY_WEIGHT, 4.0) * C("urgency") * C("impact") / dims.pick("effort", dims.EFFORT_DIVISOR, 2.0)
    return df.withColumn("priority", F.greatest(F.lit(0.0), F.least(F.lit(200.0), F.round(raw, 1))))


def impact_factors(df: DataFrame, commits: DataFrame | None = None, usage: float = 100, criticality: float = 50, churn: float = 30, velocity: float = 40, regulatory: float = 80) -> DataFrame:
    """Five factors from 0 to 10 and their weighted total (SCO-2 to SCO-8).  commits: file, n in the last 90 days."""
    hits, marks = dims.contains_count(C("file"), dims.CRITICAL_PARTS), dims.contains_count(F.concat_ws(" ", "file", "description"), dims.REGULATED_PARTS) + C("tags")
    df = df.join(commits, "file", "left") if commits is not None else df.withColumn("n_commits", F.lit(0))
    return (
        df.withColumn("f_usage", F.when(C("usage_frequency") <= 0, 0.0).otherwise(F.least(F.lit(10.0), F.round(F.log10(F.greatest(C("usage_frequency"), F.lit(1)).cast("double")) * 3.33, 1))))
        .withColumn("f_critical", F.when(C("criticality_level") == "critical", 10.0).when(C("criticality_level") == "high", 7.0).when(hits >= 2, 10.0).when(hits == 1, 7.0).otherwise(3.0))
        .withColumn("f_churn", F.least(F.lit(10.0), F.coalesce(C("n_commits"), F.lit(0)).cast("double")))
        .withColumn("f_velocity", F.least(F.lit(10.0), F.greatest(C("blocked"), F.lit(0)) * 2.0))
        .withColumn("f_regulatory", F.when(marks >= 3, 10.0).when(marks == 2, 8.0).when(marks == 1, 5.0).otherwise(0.0))
        .withColumn("impact_total", F.round(usage * C("f_usage") + criticality * C("f_critical") + churn * C("f_churn") + velocity * C("f_velocity") + regulatory * C("f_regulatory"), 2))
    )


def recent_commits(commits: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Commits of each file in the days before ``as_of`` (SRC-7, SCO-5)."""
    return commits.filter(C("ts") >= as_of - F.expr(f"interval {days} days")).groupBy("file").agg(F.count(F.lit(1)).alias("n_commits"))


def business_level(df: DataFrame) -> DataFrame:
    """critical, high, medium or low from score or severity, with advice (AGG-36)."""
    t, s = C("impact_total"), C("severity")
    level = F.when((t > 500) | (s == "critical"), "critical").when((t > 200) | (s == "high"), "high").when((t > 100) | (s == "medium"), "medium").otherwise("low")
    advice = F.when(C("level") == "critical", "Fix immediately").when(C("level").isin("high", "medium"), "Schedule for next sprint").otherwise("Add to backlog")
    return df.withColumn("level", level).withColumn("advice", advice).withColumn("sla_risk", C("level").isin("critical", "high"))


def finding_roi(df: DataFrame, rate: float = 75.0, fix_cost: float = 0.5) -> DataFrame:
    """Hours and money that fixing one finding saves (AGG-11)."""
    hours = dims.pick("severity", dims.SEVERITY_HOURS, 1.0) * dims.pick("type", dims.TYPE_MULTIPLIER, 1.0)
    return df.withColumn("hours", hours).withColumn("inaction_usd", C("hours") * rate).withColumn("roi_pct", (C("inaction_usd") - fix_cost) / fix_cost * 100)


def plan_confidence(df: DataFrame) -> DataFrame:
    """10 less what speaks against a plan, held between 1 and 10, and the reasons (SCO-9)."""
    less = [
        (~C("has_tests"), 3, "no_tests"),
        (C("changes_signature"), 2, "signature_change"),
        (C("n_files") > 3, 2, "multi_file"),
        ((C("n_files") > 1) & (C("n_files") <= 3), 1, "few_files"),
        (C("manual"), 2, "manual_verification"),
        (C("n_changes") > 5, 1, "many_changes"),
        (C("call_sites") > 20, 2, "call_sites"),
        ((C("call_sites") > 10) & (C("call_sites") <= 20), 1, "some_call_sites"),
        (C("coverage") < 50, 1, "low_coverage"),
        (C("usage_frequency") > 100, 1, "hot_path"),
        (C("criticality_level") == "critical", 1, "critical_path"),
    ]
    score, reasons = F.lit(10) - C("adjustment"), []
    for when, points, name in less:
        score = score - F.when(when, points).otherwise(0)
        reasons.append(F.when(when, F.lit(f"{name}: -{points}")))
    return df.withColumn("confidence", F.greatest(F.lit(1), F.least(F.lit(10), score)).cast("int")).withColumn("reasons", F.array_compact(F.array(*reasons)))


def reviewer_effort(df: DataFrame) -> DataFrame:
    """low, medium or high (SCO-10)."""
    high = (C("confidence") < 5) | ((C("call_sites") > 20) & (C("n_files") > 3))
    low = (C("n_files") <= 1) & (C("confidence") >= 8) & ~C("changes_signature")
    return df.withColumn("review", F.when(high, "high").when(low, "low").otherwise("medium"))


def needs_manual_check(df: DataFrame) -> DataFrame:
    """Plans below confidence 7 are checked by hand (TXT-42)."""
    return df.withColumn("manual_check", C("confidence") < 7)


def labels(df: DataFrame) -> DataFrame:
    """Labels of a pull request (SCO-20)."""
    parts = [
        F.lit("tech-debt"),
        F.lit("automated"),
        dims.pick("severity", dims.PRIORITY_LABEL, "P3-medium"),
        dims.pick("type", dims.TYPE_LABEL, None),
        F.concat(F.lit("risk:"), C("risk")),
        F.concat(F.lit("effort:"), C("effort")),
        F.when(C("confidence") >= 8, "high-confidence").when(C("confidence") <= 4, "low-confidence"),
    ]
    return df.withColumn("labels", F.array_compact(F.array(*parts)))


def work_effort(df: DataFrame) -> DataFrame:
    """Effort class of a work item (SCO-18) and its board priority (SCO-19)."""
    t = C("type")
    effort = F.when(t.isin("todo_comment", "missing_type_hints"), "trivial").when(t == "deprecated_api", "small").when(t.isin("code_smell", "security"), "medium").otherwise("small")
    return df.withColumn("work_effort", effort).withColumn("board_priority", dims.pick("severity", dims.BOARD_PRIORITY, 3))


def route(df: DataFrame) -> DataFrame:
    """Which model class and which agent a finding goes to (SCO-21, SCO-22)."""
    model = F.when(C("severity").isin("critical", "high"), "reasoning").when(C("severity") == "medium", "balanced").otherwise("fast")
    agents = {"security": "security", "deprecated_api": "modernization", "code_smell": "quality", "type_coverage": "types"}
    return df.withColumn("model_class", model).withColumn("agent", dims.pick("type", agents, "general"))


def release_gate(df: DataFrame) -> DataFrame:
    """Whether a pull request may be opened now, given the sprint's state (FIL-19)."""
    urgent = C("severity").isin("critical", "high") & (C("type") == "security")
    p = C("priority_score")
    allowed = (
        F.when(C("frozen"), urgent)
        .when((C("days_left") < 3) & (p < 150), False)
        .when((C("incidents") > 0) & (p < 100), False)
        .when(C("at_risk") & (p <= 150), False)
        .when(C("capacity_pct") > 90, False)
        .otherwise(True)
    )
    return df.withColumn("allowed", allowed)


def needs_approval(df: DataFrame, sensitive: list[str], approved_repos: list[str], categories: list[str], plans: bool = True, prs: bool = False) -> DataFrame:
    """First rule that fits decides (FIL-13)."""
    kind = C("resource_type")
    out = (
        F.when(dims.any_glob(C("file"), sensitive), True)
        .when(C("repo").isin(approved_repos), False)
        .when(C("type").isin(categories), True)
        .when(kind == "plan", plans)
        .when(kind == "pr", prs)
        .otherwise(False)
    )
    return df.withColumn("needs_approval", out)


def path_policy(df: DataFrame, deny: list[str], allow: list[str] | None = None) -> DataFrame:
    """Denied paths first, then the allowed ones (FIL-10)."""
    return df.withColumn("path_allowed", ~dims.any_glob(C("file"), deny) & dims.any_glob(C("file"), allow or ["**"]))


def proposal_gate(df: DataFrame, sensitive: list[str], types: list[str], proposal: int, confidence: int) -> DataFrame:
    """Plans that are only proposed (FIL-11, FIL-12)."""
    sensitive_or_type = dims.any_glob(C("file"), sensitive) | C("type").isin(types)
    return df.withColumn("propose_only", (C("confidence") < proposal) | (C("confidence") < confidence) | sensitive_or_type)


def critical_path(df: DataFrame, least: int = 9) -> DataFrame:
    """Changes of critical files need a high confidence (FIL-21)."""
    name = F.element_at(F.split("file", "/"), -1)
    folder = F.lit(False)
    for d in dims.CRITICAL_DIRS:
        folder = folder | C("file").contains(d)
    hit = name.isin(dims.CRITICAL_FILES) | folder
    return df.withColumn("critical_path", hit).withColumn("passes", ~hit | (C("confidence") >= least))


def complex_finding(df: DataFrame) -> DataFrame:
    """Findings that deserve alternatives (FIL-23)."""
    return df.withColumn("is_complex", (C("complexity") > 10) | C("multi_file") | (C("severity") == "critical"))


def event_hits(findings: DataFrame, events: DataFrame) -> DataFrame:
    """seq and eseq of every boost that meets a finding: the values of a field meet the targets by an index, not findings events (FIL-8, FIL-9)."""
    path = lambda c: F.lower(F.replace(C(c), F.lit("\\"), F.lit("/")))
    known = ("production_incident", "cve_announced", "deadline_approaching", "budget_exceeded", "team_capacity_change")
    ways = [("file", path("file"), C("kind") == "production_incident", matching.ending_either_way)]
    ways += [(c, F.lower(c), C("kind") == "cve_announced", matching.containing) for c in ("cve", "description")]
    ways += [("library", F.lower("library"), C("kind").isin("cve_announced", "deadline_approaching"), matching.containing)]
    ways += [("file", F.lower("file"), ~C("kind").isin(*known), matching.containing)]
    out = None
    for _, value, kinds, join in ways:
        asked = events.filter(kinds & (C("target") != "")).select("eseq", (path("target") if join is matching.ending_either_way else F.lower("target")).alias("needle"))
        valued = findings.select("seq", value.alias("text"))
        pairs = join(valued, asked).join(asked, "needle").select("text", "eseq")
        hits = valued.join(pairs, "text").select("seq", "eseq")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def reprioritise(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Fold boosts and pauses of an ordered event log into the findings (SCO-11 to SCO-17).

    events: eseq, kind, target, boost, ratio.  A finding's score only changes at its own hits, so a pause is sought in
    the stretches between these: every event knows the next event of each kind of pause, and a stretch holds one
    if that comes before the next hit.
    """
    pauses = {"budget": C("kind") == "budget_exceeded", "capacity": (C("kind") == "team_capacity_change") & (C("ratio") < 0.5)}
    log = events.select("eseq", "boost", *[F.when(when, C("eseq")).alias(f"at_{k}") for k, when in pauses.items()])
    for k in pauses:
        log = running.running(log.withColumn("_one", F.lit(0)), ["_one"], [F.desc("eseq")], C(f"at_{k}"), f"next_{k}", least=True).drop("_one", f"next_{k}_all")
    log, _ = graph.stored(log.select("eseq", "boost", "next_budget", "next_capacity"))
    first = log.agg(F.min("next_budget").alias("next_budget"), F.min("next_capacity").alias("next_capacity"))
    hits = event_hits(findings, events).join(log, "eseq").select("seq", "eseq", C("boost").alias("gain"), "next_budget", "next_capacity")
    starts = findings.select("seq", F.lit(None).cast(hits.schema["eseq"].dataType).alias("eseq"), F.lit(0.0).alias("gain"), *[first.select(f"next_{k}").scalar().alias(f"next_{k}") for k in pauses])
    by = Window.partitionBy("seq").orderBy(F.asc_nulls_first("eseq"))
    steps = starts.unionByName(hits).withColumn("gained", F.sum("gain").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("eseq").over(by))
    held = lambda k: C(f"next_{k}").isNotNull() & (C("until").isNull() | (C(f"next_{k}") < C("until")))
    met = steps.join(findings.select("seq", "priority_score", "business_impact_score"), "seq").withColumn("score_then", C("priority_score") + C("gained"))
    pause = (held("budget") & (C("score_then") + C("business_impact_score") < 100)) | (held("capacity") & (C("score_then") < 50))
    return met.groupBy("seq").agg((F.first("priority_score") + F.sum("gain")).alias("priority"), F.max(pause).alias("paused"), F.sum((C("gain") > 0).cast("long")).alias("n_boosts"))


def active(scored: DataFrame) -> DataFrame:
    """The findings that no event has paused (FIL-7)."""
    return scored.filter(~C("paused"))


def framework_mention(df: DataFrame, names: list[str]) -> DataFrame:
    """The first framework, in the given order, that a deprecation or migration mentions (SCO-23, FIL-25)."""
    low = F.lower("description")
    found = F.coalesce(*[F.when(low.contains(n), F.lit(n)) for n in names])
    return df.withColumn("framework", F.when(low.contains("deprecated") | low.contains("migration"), found))
