"""Queries over findings: scores, gates, dedup, order, batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import ranking, scoring
from .catalogue import query

C = F.col
P = dims.pick_sql
KEY = "substr(sha256(type || ':' || file || ':' || line || ':' || description), 1, 16)"
DEDUP = f"kd AS (SELECT *, {KEY} AS dedup_key FROM findings), dd AS (SELECT * FROM kd QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY seq) = 1)"


def glob_sql(column: str, globs: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{dims.glob_to_regex(g)}')" for g in globs) + ")"


def deduped(v):
    return ranking.first_of(v.findings.withColumn("dedup_key", ranking.dedup_key()), "dedup_key")


@query(f"SELECT seq, {KEY} AS dedup_key FROM findings", "findings")
def dedup_keys(v):
    return v.findings.select("seq", ranking.dedup_key().alias("dedup_key"))


@query(f"WITH {DEDUP} SELECT dedup_key, seq, type, severity, file, line FROM dd", "findings")
def dedup_findings(v):
    return deduped(v).select("dedup_key", "seq", "type", "severity", "file", "line")


@query(f"WITH {DEDUP} SELECT seq, dedup_key FROM dd WHERE dedup_key NOT IN (SELECT dedup_key FROM kd WHERE seq % 3 = 0)", "findings")
def seen_anti_join(v):
    all_ = v.findings.withColumn("dedup_key", ranking.dedup_key())
    return ranking.unseen(all_, all_.filter("seq % 3 = 0").select("dedup_key").distinct()).select("seq", "dedup_key")


@query(
    f"SELECT seq, greatest(0, least(200, round(5 * {P('severity', dims.SEVERITY_WEIGHT, 4.0)} * urgency * impact / {P('effort', dims.EFFORT_DIVISOR, 2.0)}, 1)))::DOUBLE AS priority FROM findings",
    "findings",
)
def unified_priority(v):
    return scoring.unified_priority(v.findings).select("seq", "priority")


CRIT = dims.contains_count_sql("file", dims.CRITICAL_PARTS)
MARKS = dims.contains_count_sql("(file || ' ' || description)", dims.REGULATED_PARTS) + " + tags"
IMPACT = f"""commits AS (SELECT 'src/d' || (l_partkey % 7) || '/f' || (l_suppkey % 50) || '.py' AS file, count(*) AS n_commits FROM lineitem
  WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY GROUP BY 1),
fac AS (SELECT f.*, CASE WHEN usage_frequency <= 0 THEN 0 ELSE least(10, round(log10(greatest(usage_frequency, 1)) * 3.33, 1)) END::DOUBLE AS f_usage,
  CASE WHEN criticality_level = 'critical' THEN 10 WHEN criticality_level = 'high' THEN 7 WHEN {CRIT} >= 2 THEN 10 WHEN {CRIT} = 1 THEN 7 ELSE 3 END::DOUBLE AS f_critical,
  least(10, coalesce(n_commits, 0))::DOUBLE AS f_churn, least(10, blocked * 2)::DOUBLE AS f_velocity,
  CASE WHEN {MARKS} >= 3 THEN 10 WHEN {MARKS} = 2 THEN 8 WHEN {MARKS} = 1 THEN 5 ELSE 0 END::DOUBLE AS f_regulatory FROM findings f LEFT JOIN commits c USING (file)),
imp AS (SELECT *, round(100 * f_usage + 50 * f_critical + 30 * f_churn + 40 * f_velocity + 80 * f_regulatory, 2) AS impact_total FROM fac)"""


def impact(v):
    ship = v.table("lineitem")
    log = ship.select(F.concat(F.lit("src/d"), C("l_partkey") % 7, F.lit("/f"), C("l_suppkey") % 50, F.lit(".py")).alias("file"), C("l_shipdate").alias("ts"))
    last = ship.agg(F.max("l_shipdate")).first()[0]
    return scoring.impact_factors(v.findings, scoring.recent_commits(log, F.lit(last)))


@query(f"WITH {IMPACT} SELECT seq, f_usage, f_critical, f_churn, f_velocity, f_regulatory, impact_total FROM imp", "findings")
def business_impact(v):
    return impact(v).select("seq", "f_usage", "f_critical", "f_churn", "f_velocity", "f_regulatory", "impact_total")


@query("""SELECT 'src/d' || (l_partkey % 7) || '/f' || (l_suppkey % 50) || '.py' AS file, count(*) AS n_commits FROM lineitem
  WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY GROUP BY 1""")
def recent_commits(v):
    ship = v.table("lineitem")
    log = ship.select(F.concat(F.lit("src/d"), C("l_partkey") % 7, F.lit("/f"), C("l_suppkey") % 50, F.lit(".py")).alias("file"), C("l_shipdate").alias("ts"))
    return scoring.recent_commits(log, F.lit(ship.agg(F.max("l_shipdate")).first()[0]))


@query(
    f"""WITH {IMPACT}, l AS (SELECT seq, CASE WHEN impact_total > 500 OR severity = 'critical' THEN 'critical' WHEN impact_total > 200 OR severity = 'high' THEN 'high' WHEN impact_total > 100 OR severity = 'medium' THEN 'medium' ELSE 'low' END AS level FROM imp)
SELECT seq, level, CASE level WHEN 'critical' THEN 'Fix immediately' WHEN 'low' THEN 'Add to backlog' ELSE 'Schedule for next sprint' END AS advice, level IN ('critical', 'high') AS sla_risk FROM l""",
    "findings",
)
def business_level(v):
    return scoring.business_level(impact(v)).select("seq", "level", "advice", "sla_risk")


@query(f"WITH {IMPACT} SELECT seq, impact_total FROM imp ORDER BY impact_total DESC, seq LIMIT 50", "findings")
def top_impact(v):
    return ranking.top_k(impact(v), 50, F.desc("impact_total"), F.asc("seq")).select("seq", "impact_total")


@query(f"WITH h AS (SELECT seq, {P('severity', dims.SEVERITY_HOURS, 1.0)} * {P('type', dims.TYPE_MULTIPLIER, 1.0)} AS hours FROM findings) SELECT seq, hours, hours * 75 AS inaction_usd, (hours * 75 - 0.5::DOUBLE) / 0.5::DOUBLE * 100 AS roi_pct FROM h", "findings")
def roi_per_finding(v):
    return scoring.finding_roi(v.findings).select("seq", "hours", "inaction_usd", "roi_pct")


PLANS = """plans AS (SELECT o_orderkey AS seq, o_orderkey % 3 <> 0 AS has_tests, o_orderkey % 5 = 0 AS changes_signature, (o_custkey % 6)::INT AS n_files, o_orderkey % 7 = 0 AS manual, (o_custkey % 9)::INT AS n_changes,
  (o_orderkey % 31)::INT AS call_sites, (o_custkey % 100)::INT AS coverage, (o_orderkey % 150)::INT AS usage_frequency, CASE WHEN o_orderkey % 29 = 0 THEN 'critical' ELSE 'normal' END AS criticality_level, (o_custkey % 3 - 1)::INT AS adjustment FROM orders),
conf AS (SELECT *, greatest(1, least(10, 10 - adjustment - (NOT has_tests)::INT * 3 - changes_signature::INT * 2 - CASE WHEN n_files > 3 THEN 2 WHEN n_files > 1 THEN 1 ELSE 0 END - manual::INT * 2 - (n_changes > 5)::INT
  - CASE WHEN call_sites > 20 THEN 2 WHEN call_sites > 10 THEN 1 ELSE 0 END - (coverage < 50)::INT - (usage_frequency > 100)::INT - (criticality_level = 'critical')::INT))::INT AS confidence,
  list_filter([CASE WHEN NOT has_tests THEN 'no_tests: -3' END, CASE WHEN changes_signature THEN 'signature_change: -2' END, CASE WHEN n_files > 3 THEN 'multi_file: -2' END, CASE WHEN n_files IN (2, 3) THEN 'few_files: -1' END, CASE WHEN manual THEN 'manual_verification: -2' END,
    CASE WHEN n_changes > 5 THEN 'many_changes: -1' END, CASE WHEN call_sites > 20 THEN 'call_sites: -2' END, CASE WHEN call_sites BETWEEN 11 AND 20 THEN 'some_call_sites: -1' END, CASE WHEN coverage < 50 THEN 'low_coverage: -1' END, CASE WHEN usage_frequency > 100 THEN 'hot_path: -1' END,
    CASE WHEN criticality_level = 'critical' THEN 'critical_path: -1' END], lambda x: x IS NOT NULL) AS reasons FROM plans)"""


def plans(v):
    k, c = C("o_orderkey"), C("o_custkey")
    return v.table("orders").select(
        k.alias("seq"), (k % 3 != 0).alias("has_tests"), (k % 5 == 0).alias("changes_signature"), (c % 6).cast("int").alias("n_files"), (k % 7 == 0).alias("manual"), (c % 9).cast("int").alias("n_changes"), (k % 31).cast("int").alias("call_sites"),
        (c % 100).cast("int").alias("coverage"), (k % 150).cast("int").alias("usage_frequency"), F.when(k % 29 == 0, "critical").otherwise("normal").alias("criticality_level"), (c % 3 - 1).cast("int").alias("adjustment"),
    )


@query(f"WITH {PLANS} SELECT seq, confidence, array_to_string(reasons, '; ') AS reasons, confidence < 7 AS manual_check FROM conf")
def plan_confidence(v):
    return scoring.needs_manual_check(scoring.plan_confidence(plans(v))).select("seq", "confidence", F.array_join("reasons", "; ").alias("reasons"), "manual_check")


@query(f"WITH {PLANS} SELECT seq, CASE WHEN confidence < 5 OR (call_sites > 20 AND n_files > 3) THEN 'high' WHEN n_files <= 1 AND confidence >= 8 AND NOT changes_signature THEN 'low' ELSE 'medium' END AS review FROM conf")
def reviewer_effort(v):
    return scoring.reviewer_effort(scoring.plan_confidence(plans(v))).select("seq", "review")


LABELLED = "lab AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk, (seq % 10 + 1)::INT AS confidence FROM findings)"


def labelled(v):
    return v.findings.withColumn("risk", F.when(C("seq") % 3 == 0, "low").when(C("seq") % 3 == 1, "medium").otherwise("high")).withColumn("confidence", (C("seq") % 10 + 1).cast("int"))


@query(
    f"""WITH {LABELLED} SELECT seq, array_to_string(list_filter(['tech-debt', 'automated', {P('severity', dims.PRIORITY_LABEL, 'P3-medium')}, {P('type', dims.TYPE_LABEL, None)}, 'risk:' || risk, 'effort:' || effort,
  CASE WHEN confidence >= 8 THEN 'high-confidence' WHEN confidence <= 4 THEN 'low-confidence' END], lambda x: x IS NOT NULL), ',') AS labels FROM lab""",
    "findings",
)
def label_select(v):
    return scoring.labels(labelled(v)).select("seq", F.array_join("labels", ",").alias("labels"))


@query(
    f"""SELECT seq, CASE WHEN type IN ('todo_comment', 'missing_type_hints') THEN 'trivial' WHEN type = 'deprecated_api' THEN 'small' WHEN type IN ('code_smell', 'security') THEN 'medium' ELSE 'small' END AS work_effort,
  {P('severity', dims.BOARD_PRIORITY, 3)} AS board_priority, CASE WHEN severity IN ('critical', 'high') THEN 'reasoning' WHEN severity = 'medium' THEN 'balanced' ELSE 'fast' END AS model_class,
  CASE type WHEN 'security' THEN 'security' WHEN 'deprecated_api' THEN 'modernization' WHEN 'code_smell' THEN 'quality' WHEN 'type_coverage' THEN 'types' ELSE 'general' END AS agent FROM findings""",
    "findings",
)
def work_items(v):
    return scoring.route(scoring.work_effort(v.findings)).select("seq", "work_effort", "board_priority", "model_class", "agent")


@query(
    """WITH g AS (SELECT *, seq % 4 = 0 AS frozen, (seq % 9)::INT AS days_left, (seq % 3)::INT AS incidents, seq % 5 = 0 AS at_risk, (seq % 101)::DOUBLE AS capacity_pct FROM findings)
SELECT seq, CASE WHEN frozen THEN severity IN ('critical', 'high') AND type = 'security' WHEN days_left < 3 AND priority_score < 150 THEN false WHEN incidents > 0 AND priority_score < 100 THEN false
  WHEN at_risk AND priority_score <= 150 THEN false WHEN capacity_pct > 90 THEN false ELSE true END AS allowed FROM g""",
    "findings",
)
def pr_gate(v):
    s = C("seq")
    return scoring.release_gate(v.findings.select("*", (s % 4 == 0).alias("frozen"), (s % 9).cast("int").alias("days_left"), (s % 3).cast("int").alias("incidents"), (s % 5 == 0).alias("at_risk"), (s % 101).cast("double").alias("capacity_pct"))).select("seq", "allowed")


ALLOWED = ["**/auth/**", "**/pii/**"]


@query(
    f"""WITH r AS (SELECT seq, file, type, 'repo' || (seq % 6) AS repo, CASE seq % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'pr' ELSE 'execution' END AS resource_type FROM findings)
SELECT seq, CASE WHEN {glob_sql('file', ALLOWED)} THEN true WHEN repo IN ('repo1', 'repo2') THEN false WHEN type IN ('security') THEN true WHEN resource_type = 'plan' THEN true WHEN resource_type = 'pr' THEN false ELSE false END AS needs_approval FROM r""",
    "findings",
)
def needs_approval(v):
    s = C("seq")
    rows = v.findings.select("seq", "file", "type", F.concat(F.lit("repo"), s % 6).alias("repo"), F.when(s % 3 == 0, "plan").when(s % 3 == 1, "pr").otherwise("execution").alias("resource_type"))
    return scoring.needs_approval(rows, ALLOWED, ["repo1", "repo2"], ["security"]).select("seq", "needs_approval")


@query(f"SELECT seq, NOT {glob_sql('file', ['src/auth/*', '*f7.py'])} AND {glob_sql('file', ['src/*'])} AS path_allowed FROM findings", "findings")
def path_policy(v):
    return scoring.path_policy(v.findings, ["src/auth/*", "*f7.py"], ["src/*"]).select("seq", "path_allowed")


@query(f"WITH {LABELLED} SELECT seq, confidence < 5 OR confidence < 7 OR {glob_sql('file', ALLOWED)} OR type IN ('dependency_upgrade') AS propose_only FROM lab", "findings")
def proposal_gate(v):
    return scoring.proposal_gate(labelled(v), ALLOWED, ["dependency_upgrade"], 5, 7).select("seq", "propose_only")


FILES = "cp AS (SELECT *, list_contains(['" + "', '".join(dims.CRITICAL_FILES) + "'], string_split(file2, '/')[-1]) OR " + " OR ".join(f"contains(file2, '{d}')" for d in dims.CRITICAL_DIRS) + " AS hit FROM (SELECT *, CASE WHEN seq % 31 = 0 THEN 'src/main.py' ELSE file END AS file2 FROM lab))"


@query(f"WITH {LABELLED}, {FILES} SELECT seq, hit AS critical_path, NOT hit OR confidence >= 9 AS passes FROM cp", "findings")
def critical_path(v):
    return scoring.critical_path(labelled(v).withColumn("file", F.when(C("seq") % 31 == 0, "src/main.py").otherwise(C("file")))).select("seq", "critical_path", "passes")


@query("SELECT seq, usage_frequency > 10 OR tags > 1 OR severity = 'critical' AS is_complex FROM findings", "findings")
def complex_findings(v):
    return scoring.complex_finding(v.findings.withColumn("complexity", C("usage_frequency")).withColumn("multi_file", C("tags") > 1)).select("seq", "is_complex")


EVENTS = [
    (1, "production_incident", "src/d3/f3.py", 200.0, 1.0),
    (2, "cve_announced", "CVE-2024-1", 300.0, 1.0),
    (3, "team_capacity_change", "", 0.0, 0.4),
    (4, "deadline_approaching", "lib2", 150.0, 1.0),
    (5, "budget_exceeded", "", 0.0, 1.0),
    (6, "custom", "src/auth", 25.0, 1.0),
]


MET = """met AS (SELECT f.seq, f.priority_score, f.business_impact_score, e.*, CASE
    WHEN kind = 'production_incident' AND target <> '' AND (lower(file) = lower(target) OR ends_with(lower(file), lower(target)) OR ends_with(lower(target), lower(file))) THEN boost
    WHEN kind = 'cve_announced' AND target <> '' AND (contains(lower(cve), lower(target)) OR contains(lower(library), lower(target)) OR contains(lower(description), lower(target))) THEN boost
    WHEN kind = 'deadline_approaching' AND target <> '' AND contains(lower(library), lower(target)) THEN boost
    WHEN kind = 'custom' AND target <> '' AND contains(lower(file), lower(target)) THEN boost ELSE 0 END AS gain FROM findings f, ev e),
thn AS (SELECT *, priority_score + sum(gain) OVER (PARTITION BY seq ORDER BY eseq) AS then_score FROM met),
folded AS (SELECT seq, (min(priority_score) + sum(gain))::DOUBLE AS priority, max((kind = 'budget_exceeded' AND then_score + business_impact_score < 100) OR (kind = 'team_capacity_change' AND ratio < 0.5 AND then_score < 50)) AS paused, sum((gain > 0)::INT)::BIGINT AS n_boosts FROM thn GROUP BY seq)"""
FEW = f"ev AS (SELECT * FROM {dims.values_sql(EVENTS, 'eseq, kind, target, boost, ratio')})"


def few(v):
    return v.spark.createDataFrame(EVENTS, "eseq int, kind string, target string, boost double, ratio double")


@query(f"WITH {FEW}, {MET} SELECT * FROM folded", "findings")
def reprioritize_events(v):
    return scoring.reprioritise(v.findings, few(v))


@query(f"WITH {FEW}, {MET} SELECT seq, priority FROM folded WHERE NOT paused", "findings")
def active_findings(v):
    return scoring.active(scoring.reprioritise(v.findings, few(v))).select("seq", "priority")


@query(
    f"""WITH ev AS (SELECT min(event_id) AS eseq, CASE event_type WHEN 'error' THEN 'production_incident' WHEN 'purchase' THEN 'cve_announced' WHEN 'signup' THEN 'deadline_approaching' WHEN 'view' THEN 'team_capacity_change' WHEN 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'budget_exceeded' ELSE 'custom' END END AS kind,
    CASE event_type WHEN 'error' THEN 'd' || (user_id % 7) || '/f' || user_id || '.py' WHEN 'purchase' THEN 'cve-2024-' || user_id WHEN 'signup' THEN 'lib' || user_id WHEN 'view' THEN '' ELSE 'src/auth/f' || user_id END AS target,
    (user_id % 5 + 1)::DOUBLE AS boost, (user_id % 10)::DOUBLE / 10 AS ratio FROM events GROUP BY user_id, event_type),
{MET} SELECT * FROM folded""",
    "findings",
)
def reprioritize_log(v):
    """The first event of each user and type, as the log that is folded."""
    t, u = C("event_type"), C("user_id")
    first = v.table("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("eseq"))
    kind = F.when(t == "error", "production_incident").when(t == "purchase", "cve_announced").when(t == "signup", "deadline_approaching").when(t == "view", "team_capacity_change")
    kind = kind.when((t == "click") & (u % 3 == 0), "budget_exceeded").when(t == "click", "custom")
    target = F.when(t == "error", F.concat(F.lit("d"), u % 7, F.lit("/f"), u, F.lit(".py"))).when(t == "purchase", F.concat(F.lit("cve-2024-"), u)).when(t == "signup", F.concat(F.lit("lib"), u)).when(t == "view", "").otherwise(F.concat(F.lit("src/auth/f"), u))
    log = first.select("eseq", kind.alias("kind"), target.alias("target"), (u % 5 + 1).cast("double").alias("boost"), ((u % 10).cast("double") / 10).alias("ratio"))
    return scoring.reprioritise(v.findings, log)


NAMES = ["flask", "django", "lib"]


@query("SELECT seq, CASE WHEN contains(lower(description), 'deprecated') OR contains(lower(description), 'migration') THEN CASE WHEN contains(lower(description), 'flask') THEN 'flask' WHEN contains(lower(description), 'django') THEN 'django' WHEN contains(lower(description), 'lib') THEN 'lib' END END AS framework FROM findings", "findings")
def framework_mentions(v):
    return scoring.framework_mention(v.findings, NAMES).select("seq", "framework")


@query("SELECT seq, priority_score + business_impact_score AS score, row_number() OVER (ORDER BY priority_score + business_impact_score DESC, seq) AS position FROM findings", "findings")
def prioritized(v):
    return ranking.prioritised(v.findings).select("seq", "score", "position")


@query("SELECT seq, severity, file, priority_score, row_number() OVER (ORDER BY priority_score DESC, seq) AS place FROM findings ORDER BY place LIMIT 10", "findings")
def review_top_findings(v):
    """The ten findings that a review shows (AGG-5)."""
    top = ranking.top_k(v.findings, 10, F.desc("priority_score"), F.asc("seq"))
    return top.select("seq", "severity", "file", "priority_score", F.row_number().over(Window.orderBy(F.desc("priority_score"), "seq")).alias("place"))


@query("SELECT seq, file, 1 AS batch FROM findings ORDER BY seq LIMIT 7", "findings")
def pr_batch_unsplit(v):
    return ranking.batches(v.findings, max_prs=7, auto_split=False).select("seq", "file", "batch")


@query("SELECT c_custkey AS plan, 'F' || (c_custkey * 3 % 40000) AS finding_id, type, severity, file FROM customer LEFT JOIN findings ON 'F' || seq = 'F' || (c_custkey * 3 % 40000)", "findings")
def plans_with_findings(v):
    """Plans with the finding that each names, if it is known (JOIN-3)."""
    known = v.findings.select(F.concat(F.lit("F"), C("seq")).alias("finding_id"), "type", "severity", "file")
    plans = v.table("customer").select(C("c_custkey").alias("plan"), F.concat(F.lit("F"), C("c_custkey") * 3 % 40000).alias("finding_id"))
    return plans.join(known, "finding_id", "left").select("plan", "finding_id", "type", "severity", "file")


@query(f"WITH w AS (SELECT seq, {P('severity', dims.SEVERITY_RANK, 5)} + {P('type', dims.TYPE_BONUS, 5)} AS rank_key, file, line FROM findings) SELECT seq, rank_key::INT AS rank_key, row_number() OVER (ORDER BY rank_key, file, line, seq) AS position FROM w", "findings")
def work_item_order(v):
    rows = v.findings.withColumn("rank_key", ranking.work_order_key())
    return ranking.numbered(rows, [F.asc("rank_key"), F.asc("file"), F.asc("line"), F.asc("seq")]).select("seq", "rank_key", "position")


@query(
    """WITH a AS (SELECT seq, regexp_replace(file, '/[^/]*$', '') AS folder FROM findings), b AS (SELECT *, min(seq) OVER (PARTITION BY folder) AS ff, row_number() OVER (PARTITION BY folder ORDER BY seq) AS rn FROM a),
c AS (SELECT *, (rn - 1) // 5 AS part FROM b), h AS (SELECT ff, part, row_number() OVER (ORDER BY ff, part)::INT AS batch FROM (SELECT DISTINCT ff, part FROM c)) SELECT seq, folder, batch FROM c JOIN h USING (ff, part) WHERE batch <= 5""",
    "findings",
)
def pr_batches(v):
    return ranking.batches(v.findings).select("seq", "folder", "batch")


ALTERNATIVES = "alt AS (SELECT o_custkey AS finding, o_orderkey AS seq, (o_orderkey % 10 + 1)::INT AS confidence, (o_orderkey % 4)::INT AS n_changes FROM orders)"


@query(f"WITH {ALTERNATIVES} SELECT * FROM alt QUALIFY row_number() OVER (PARTITION BY finding ORDER BY confidence DESC, n_changes, seq) = 1")
def best_alternatives(v):
    k = C("o_orderkey")
    return ranking.best_alternative(v.table("orders").select(C("o_custkey").alias("finding"), k.alias("seq"), (k % 10 + 1).cast("int").alias("confidence"), (k % 4).cast("int").alias("n_changes")))


@query("SELECT seq, type, severity, file FROM findings WHERE type = 'security' AND severity = 'high' AND contains(lower(file), 'auth')", "findings")
def filter_findings(v):
    return v.findings.filter((C("type") == "security") & (C("severity") == "high") & F.lower("file").contains("auth")).select("seq", "type", "severity", "file")


@query("SELECT seq, type, severity, file, line, description, priority_score FROM findings WHERE NOT coalesce(resolved, false)", "findings")
def open_findings(v):
    return v.findings.filter(~F.coalesce("resolved", F.lit(False))).select("seq", "type", "severity", "file", "line", "description", "priority_score")


@query("SELECT seq, file FROM findings WHERE contains(lower(file), 'gdpr') OR contains(lower(description), 'gdpr') ORDER BY seq LIMIT 1", "findings")
def find_finding(v):
    return ranking.top_k(v.findings.filter(F.lower("file").contains("gdpr") | F.lower("description").contains("gdpr")), 1, F.asc("seq")).select("seq", "file")


@query(f"SELECT seq, severity FROM findings WHERE {P('severity', dims.SEVERITY_RANK, 5)} <= 1", "findings")
def severity_threshold(v):
    return v.findings.filter(dims.pick("severity", dims.SEVERITY_RANK, 5) <= 1).select("seq", "severity")


@query(
    """WITH f AS (SELECT *, 'pattern ' || (seq % 4) AS pattern, regexp_replace(file, '/[^/]*$', '') AS folder FROM findings),
p AS (SELECT DISTINCT type, library, pattern, folder FROM f),
m AS (SELECT p.*, h.seq AS hseq, 1.0::DOUBLE + CASE WHEN lower(p.library) = lower(h.library) THEN 2 ELSE 0 END + CASE WHEN contains(lower(h.pattern), lower(p.pattern)) THEN 1.5 ELSE 0 END + CASE WHEN contains(folder, file_pattern) THEN 0.5 ELSE 0 END AS match_score
  FROM p JOIN history h ON p.type = h.finding_type),
r AS (SELECT *, row_number() OVER (PARTITION BY type, library, pattern, folder ORDER BY match_score DESC, hseq)::INT AS rank FROM m QUALIFY rank <= 5)
SELECT seq, hseq, match_score, rank FROM f JOIN r USING (type, library, pattern, folder)""",
    "findings history",
)
def similar_history(v):
    return ranking.similar_history(v.findings.withColumn("pattern", F.concat(F.lit("pattern "), C("seq") % 4)), v.history).select("seq", "hseq", "match_score", "rank")


@query(
    """WITH q AS (SELECT seq, 'f' || (seq % 50) AS file, line FROM findings) SELECT q.seq, min_by(name, f.seq) AS function, count(*) AS n_holding FROM q JOIN functions f ON f.file = q.file AND line BETWEEN start_line AND end_line GROUP BY q.seq""",
    "findings functions",
)
def enclosing_function(v):
    return ranking.enclosing_function(v.findings.select("seq", F.concat(F.lit("f"), C("seq") % 50).alias("file"), "line"), v.functions)


@query(
    """WITH m AS (SELECT *, (usr = 'user4')::INT AS is_user FROM prefs WHERE team = 'team2' AND usr IN ('user4', '')), k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY preference ORDER BY is_user DESC, seq) = 1)
SELECT seq, preference, usr, timestamp FROM k ORDER BY timestamp DESC, seq LIMIT 20""",
    "prefs",
)
def preferences_topk(v):
    return ranking.merged_preferences(v.prefs, "team2", "user4").select("seq", "preference", "usr", "timestamp")


@query("SELECT team, preference, min(seq) AS seq FROM prefs WHERE seq % 2 = 0 AND (team, preference) NOT IN (SELECT (team, preference) FROM prefs WHERE seq % 2 = 1) GROUP BY ALL", "prefs")
def preference_inserts(v):
    return ranking.insert_absent(v.prefs.filter("seq % 2 = 0"), v.prefs.filter("seq % 2 = 1"), ["team", "preference"]).select("team", "preference", "seq")


@query("SELECT id, max(seq) AS seq, max_by(status, seq) AS status FROM approvals GROUP BY id", "approvals")
def approval_state(v):
    return ranking.last_of(v.approvals, "id").select("id", "seq", "status")


@query("WITH s AS (SELECT id, max_by(status, seq) AS status, max_by(ts, seq) AS ts FROM approvals GROUP BY id) SELECT id, CASE WHEN status = 'pending' AND ts < TIMESTAMP '1997-01-01' THEN 'expired' ELSE status END AS status FROM s", "approvals")
def expired_approvals(v):
    return ranking.last_of(v.approvals, "id").select("id", F.when((C("status") == "pending") & (C("ts") < F.lit("1997-01-01").cast("timestamp")), "expired").otherwise(C("status")).alias("status"))


@query("SELECT seq FROM findings WHERE 'r' || (seq % 900) IN (SELECT resource_id FROM approvals WHERE status = 'approved')", "findings approvals")
def approved_resources(v):
    ok = v.approvals.filter("status = 'approved'").select("resource_id").distinct()
    return v.findings.select("seq", F.concat(F.lit("r"), C("seq") % 900).alias("resource_id")).join(ok, "resource_id", "left_semi").select("seq")


RBAC = [(r, p) for r, ps in dims.ROLE_PERMISSIONS.items() for p in ps]


@query(
    f"""WITH u AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'security_admin' WHEN 2 THEN 'team_lead' WHEN 3 THEN 'contributor' WHEN 4 THEN 'developer' ELSE 'viewer' END AS role, CASE c_custkey % 4 WHEN 0 THEN 'execute' WHEN 1 THEN 'scan' WHEN 2 THEN 'approve_plans' ELSE 'view_reports' END AS wants,
  c_custkey % 5 <> 0 OR c_custkey % 2 = 0 AS in_scope FROM customer), p AS (SELECT * FROM {dims.values_sql(RBAC, 'role, permission')})
SELECT id, in_scope AND EXISTS (SELECT 1 FROM p WHERE p.role = u.role AND permission IN (wants, '*')) AS allowed FROM u"""
)
def rbac_check(v):
    k = C("c_custkey")
    roles = dims.frame(v.spark, [(r, ps) for r, ps in dims.ROLE_PERMISSIONS.items()], "role string, permissions array<string>")
    from ..sources.adaptors import choose

    users = v.table("customer").select(k.alias("id"), choose(k % 6, ["admin", "security_admin", "team_lead", "contributor", "developer"], "viewer").alias("role"), choose(k % 4, ["execute", "scan", "approve_plans"], "view_reports").alias("wants"), ((k % 5 != 0) | (k % 2 == 0)).alias("in_scope"))
    return users.join(roles, "role", "left").select("id", (C("in_scope") & F.coalesce(F.array_contains("permissions", C("wants")) | F.array_contains("permissions", F.lit("*")), F.lit(False))).alias("allowed"))
