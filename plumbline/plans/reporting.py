"""Queries of reports, ledgers and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import forecast, ranking, reports
from .catalogue import query

C = F.col
P = dims.pick_sql


@query("SELECT 'type' AS facet, type AS value, count(*) AS n FROM findings GROUP BY type UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY severity", "findings")
def findings_by_type_severity(v):
    return reports.by_type_and_severity(v.findings)


@query("SELECT file, count(*) AS n, min(seq) AS first_seq FROM findings GROUP BY file ORDER BY n DESC, first_seq LIMIT 10", "findings")
def findings_hotspot_files(v):
    return reports.hotspots(v.findings, "file", 10)


@query("SELECT regexp_replace(file, '/[^/]*$', '') AS folder, count(*) AS n, min(seq) AS first_seq FROM findings GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 5", "findings")
def findings_hotspot_dirs(v):
    return reports.hotspots(v.findings.withColumn("folder", ranking.folder()), "folder", 5)


@query(f"SELECT round(avg(({P('severity', dims.SEVERITY_SCORE, 0)})::DOUBLE), 2) AS avg_severity FROM findings", "findings")
def avg_severity(v):
    return reports.average_severity(v.findings)


@query(
    """WITH s AS (SELECT count(*) AS total, count(DISTINCT file) AS files, """ + ", ".join(f"sum((severity = '{s}')::INT)::BIGINT AS n_{s}" for s in dims.SEVERITY_RANK) + """ FROM findings)
SELECT *, n_critical * 4.0::DOUBLE + n_high * 2 + n_medium + n_low * 0.5::DOUBLE AS manual_hours, (n_critical * 4.0::DOUBLE + n_high * 2 + n_medium + n_low * 0.5::DOUBLE) * 85 AS savings_usd, round(100.0::DOUBLE * n_critical / total, 4) AS pct_critical FROM s""",
    "findings",
)
def scan_summary(v):
    return reports.scan_summary(v.findings)


@query(
    """SELECT count(*) AS total, sum((severity IN ('critical', 'high'))::INT)::BIGINT AS blocking, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' WHEN count(*) > 0 THEN 'low' ELSE 'none' END AS risk,
  CASE WHEN bool_or(severity IN ('critical', 'high')) THEN 'changes-requested' ELSE 'approved-with-notes' END AS status,
  array_to_string(list_filter([CASE WHEN bool_or(severity IN ('critical', 'high')) THEN 'needs-fix' END, CASE WHEN bool_or(type = 'security') THEN 'security-risk' END, CASE WHEN bool_or(type = 'type_coverage') THEN 'type-issues' END, CASE WHEN bool_or(type = 'dependency_upgrade') THEN 'dependency-upgrade' END], lambda x: x IS NOT NULL), ',') AS labels FROM findings""",
    "findings",
)
def pr_review_summary(v):
    return reports.review_summary(v.findings)


@query(
    f"""WITH s AS (SELECT sum({P('type', dims.EFFORT_HOURS, 1.0)}) AS m, count(*) AS n FROM findings), t AS (SELECT m, n * 5.0::DOUBLE / 60.0::DOUBLE AS a FROM s)
SELECT round(m, 2) AS manual_hours, round(a, 2) AS automated_hours, round(greatest(m - a, 0), 2) AS hours_saved, round(greatest(m - a, 0) * 85, 1) AS savings_usd FROM t""",
    "findings",
)
def run_cost_savings(v):
    return reports.run_savings(v.findings)


@query(
    """WITH a AS (SELECT period, sum(ai_cost + infra_cost + setup_cost) AS c, coalesce(sum(CASE WHEN was_successful THEN manual_hours * automation_rate END), 0) AS h, count(*) AS fixes, sum(was_successful::INT)::BIGINT AS ok, avg(automation_rate) AS au FROM roi GROUP BY period), b AS (SELECT *, h * 75 AS s FROM a)
SELECT period, round(c, 4) AS cost, round(h, 2) AS hours, fixes, ok AS successful, round(CASE WHEN ok > 0 THEN c / ok ELSE 0 END, 4) AS cost_per_fix, round(s, 1) AS savings, round(CASE WHEN c > 0 THEN (s - c) / c * 100 ELSE 0 END, 1) AS net_roi_pct,
  round(CASE WHEN s > c AND c > 0 THEN c / greatest(s - c, 0.0001) ELSE 0 END, 4) AS payback_months, round(au, 4) AS automation FROM b""",
    "roi",
)
def roi_report(v):
    return reports.roi_report(v.roi)


ROI_TYPE = """rt AS (SELECT CASE WHEN finding_type = '' THEN 'unknown' ELSE finding_type END AS finding_type, round(sum(ai_cost + infra_cost + setup_cost), 3) AS cost, round(sum(manual_hours * automation_rate), 2) AS hours, count(*) AS n, round(sum(manual_hours * automation_rate) * 75, 1) AS savings FROM roi GROUP BY 1)"""


@query(f"WITH {ROI_TYPE} SELECT * FROM rt", "roi")
def roi_by_type(v):
    return reports.roi_by_type(v.roi)


@query(f"WITH {ROI_TYPE} " + " UNION ALL ".join(f"SELECT 'finding_type:' || finding_type AS section, '{k}' AS key, {k}::DOUBLE AS value FROM rt" for k in ("cost", "hours", "n", "savings")), "roi")
def roi_unpivot(v):
    return reports.unpivoted(reports.roi_by_type(v.roi), "finding_type")


@query("WITH p AS (SELECT period, sum(ai_cost + infra_cost + setup_cost) AS cost, count(*) AS fixes FROM roi GROUP BY period) SELECT period, round(cost - lag(cost) OVER (ORDER BY period), 3) AS cost_change, fixes - lag(fixes) OVER (ORDER BY period) AS fixes_change FROM p", "roi")
def roi_compare_periods(v):
    return reports.period_change(v.roi)


@query(
    """WITH s AS (SELECT sum(cost_usd) AS s, count(*) AS n, sum((operation = 'create_pr')::INT) AS p FROM costs) SELECT round(s, 3) AS spent, round(greatest(50000 - s, 0), 3) AS remaining, round(s / 50000 * 100, 3) AS usage_pct, n AS entries, round(s / greatest(p, 1), 4) AS cost_per_pr, round(s / 20 * 31, 2) AS projected FROM s""",
    "costs",
)
def budget_summary(v):
    return reports.budget(v.costs, 50_000, 20, 31)


@query("SELECT operation, count(*) AS n FROM costs WHERE operation <> '' GROUP BY operation", "costs")
def budget_ops(v):
    return reports.operation_counts(v.costs)


@query("WITH s AS (SELECT sum(cost_usd) / 6000 * 100 AS u FROM costs) SELECT t::INT AS threshold FROM s, (VALUES (50), (80), (90), (100)) AS x(t) WHERE u >= t", "costs")
def budget_alerts(v):
    return reports.budget_alerts(v.costs, 6000)


RUN = "run AS (SELECT team, seq, sum(cost_usd) OVER (PARTITION BY team ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running FROM costs)"


@query(f"WITH {RUN} SELECT team, t::INT AS threshold, min(seq) AS seq FROM run, (VALUES (50), (80), (90), (100)) AS x(t) WHERE running / 500 * 100 >= t GROUP BY ALL", "costs")
def budget_threshold_crossings(v):
    return reports.crossings(v.costs, 500)


@query(f"WITH {RUN} SELECT team, seq, round(running, 5) AS running, running > 500 AS past_limit FROM run", "costs")
def budget_hard_stop(v):
    return reports.running_spend(v.costs, 500).select("team", "seq", F.round("running", 5).alias("running"), "past_limit")


@query("SELECT period, team, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, count(*) AS requests, round(sum(cost_usd), 3) AS cost, sum(cost_usd) > 500 AS past_limit FROM costs GROUP BY ALL", "costs")
def llm_usage(v):
    return reports.usage(v.costs, 500)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY duration_seconds, seq) AS place, count(*) OVER (PARTITION BY team) AS n FROM sla),
a AS (SELECT team, count(*) AS total, sum(success::INT)::BIGINT AS successful, avg(duration_seconds) AS ad, max(CASE WHEN place = least(floor(n * 0.95::DOUBLE), n - 1) + 1 THEN duration_seconds END) AS p95, avg(CASE WHEN prs_created > 0 THEN duration_seconds END) AS tp, sum(findings_count)::BIGINT AS findings, sum(prs_created)::BIGINT AS prs, min(timestamp) AS period_start, max(timestamp) AS period_end FROM r GROUP BY team)
SELECT team, total, successful, round(100.0::DOUBLE * successful / total, 3) AS success_rate, round(ad, 3) AS avg_duration, round(p95, 4) AS p95, round(coalesce(tp, 0), 3) AS to_pr, findings, prs, period_start, period_end, (total - successful) / total * 100 > 10 AS alert FROM a""",
    "sla",
)
def sla_report(v):
    return reports.sla_report(v.sla)


@query("SELECT failure_reason AS reason, count(*) AS n, min(seq) AS first_seq FROM sla WHERE failure_reason <> '' GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 5", "sla")
def sla_top_failures(v):
    return reports.failure_reasons(v.sla)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY timestamp, seq) AS rn, count(*) OVER (PARTITION BY team) AS n FROM sla), a AS (SELECT team, max(n) AS n, avg(CASE WHEN rn <= n // 2 THEN (NOT success)::INT END) AS o, avg(CASE WHEN rn > n // 2 THEN (NOT success)::INT END) AS w FROM r GROUP BY team)
SELECT team, CASE WHEN n < 4 THEN 'stable' WHEN w < o - 0.1 THEN 'improving' WHEN w > o + 0.1 THEN 'degrading' ELSE 'stable' END AS trend, round(o, 5) AS older, round(w, 5) AS newer FROM a""",
    "sla",
)
def sla_failure_trend(v):
    return reports.failure_trend(v.sla)


@query("SELECT seq, timestamp, success FROM sla ORDER BY timestamp DESC, seq DESC LIMIT 20", "sla")
def sla_last_runs(v):
    return reports.last_runs(v.sla).select("seq", "timestamp", "success")


def rates_sql(by: str) -> str:
    return f"""WITH a AS (SELECT {by}, coalesce(avg(CASE WHEN status <> 'pending' THEN (status = 'merged')::INT END), 1.0) AS r, sum((status <> 'pending')::INT)::BIGINT AS decided FROM outcomes GROUP BY {by})
SELECT {by}, round(r, 6) AS rate, decided, CASE WHEN r >= 0.9 THEN 0 ELSE greatest(1, floor(10 * (0.9::DOUBLE - r)))::INT END AS adjustment FROM a"""


@query(rates_sql("scanner_type"), "outcomes")
def scanner_success_rates(v):
    return reports.success_rates(v.outcomes, "scanner_type")


@query(rates_sql("team"), "outcomes")
def team_success_rates(v):
    return reports.success_rates(v.outcomes, "team")


@query(
    """WITH a AS (SELECT count(*) AS total, sum((status = 'merged')::INT)::BIGINT AS merged, sum((status = 'rejected')::INT)::BIGINT AS rejected, sum((status = 'pending')::INT)::BIGINT AS pending FROM outcomes) SELECT *, round(merged / (merged + rejected), 6) AS accuracy FROM a""",
    "outcomes",
)
def learning_summary(v):
    return reports.learning_summary(v.outcomes)


@query("SELECT count(*) AS total, sum((action = 'accepted')::INT)::BIGINT AS accepted, round(avg((action = 'accepted')::INT), 6) AS accuracy FROM outcomes", "outcomes")
def feedback_accuracy(v):
    return reports.feedback_accuracy(v.outcomes)


@query("SELECT finding_type, count(*) AS n, count(DISTINCT team) AS teams, round(avg(success::INT), 6) AS rate FROM history GROUP BY finding_type", "history")
def history_success_by_type(v):
    return reports.history_rates(v.history)


@query("SELECT category, count(*) AS n, count(DISTINCT nullif(team, '')) AS teams, count(DISTINCT nullif(usr, '')) AS users FROM prefs GROUP BY category", "prefs")
def preference_summary(v):
    return reports.preference_summary(v.prefs)


@query("SELECT count(*) AS total, sum(resolved::INT)::BIGINT AS resolved, (count(*) - sum(resolved::INT))::BIGINT AS active FROM findings", "findings")
def store_trends(v):
    return reports.store_trends(v.findings)


@query("SELECT file, bool_and(severity <> 'critical') AS passed, count(*) AS n, CASE WHEN bool_and(severity <> 'critical') THEN 'proceed' ELSE 'abort' END AS action FROM findings GROUP BY file", "findings")
def safety_by_file(v):
    return reports.all_passed(v.findings, "file", "severity = 'critical'")


@query("SELECT strftime(day, '%Y-%m-%d') AS day, kind, n FROM snapshots", "snapshots")
def snapshot_by_type(v):
    return v.snapshots.withColumn("day", C("day").cast("string"))


POINTS = "pts AS (SELECT date_diff('day', min(day) OVER (), day)::DOUBLE AS x, y FROM (SELECT day, sum(n)::DOUBLE AS y FROM snapshots GROUP BY day)), reg AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n, max(x) AS m FROM pts)"
FORE = f"""{POINTS}, fit AS (SELECT s, n, m, i, sqrt((SELECT sum((y - s * x - i) ** 2) FROM pts) / greatest(n - 2, 1)) AS se FROM reg), pre AS (SELECT *, greatest(0, round_even(s * (m + 90) + i, 0))::BIGINT AS predicted, round_even(1.96::DOUBLE * se, 0)::BIGINT AS margin FROM fit)"""
TREND = "CASE WHEN s < -0.05 THEN 'improving' WHEN s > 0.05 THEN 'worsening' ELSE 'stable' END"


@query(f"WITH {POINTS} SELECT round(s, 5) AS slope, round(i, 4) AS intercept, n, {TREND} AS trend FROM reg", "snapshots")
def linear_trend(v):
    return forecast.regression(forecast.series(v.snapshots)).select(F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), "n", forecast.trend(C("slope")).alias("trend"))


@query(f"WITH {FORE} SELECT predicted, greatest(0, predicted - margin) AS low, predicted + margin AS high, {TREND} AS trend, round(s, 4) AS slope, n AS snapshots FROM pre", "snapshots")
def debt_forecast(v):
    return forecast.forecast(v.snapshots)


@query(f"WITH {FORE}, l AS (SELECT kind, n FROM snapshots WHERE day = (SELECT max(day) FROM snapshots)) SELECT kind, round_even(predicted * l.n / (SELECT sum(n) FROM l), 0)::BIGINT AS predicted FROM l, pre", "snapshots")
def forecast_by_type(v):
    return forecast.split_forecast(v.snapshots, forecast.forecast(v.snapshots))


@query("WITH e AS (SELECT min(day) AS a, max(day) AS b FROM snapshots) SELECT kind, (sum(CASE WHEN day = b THEN n ELSE 0 END) - sum(CASE WHEN day = a THEN n ELSE 0 END))::BIGINT AS growth FROM snapshots, e GROUP BY kind HAVING growth > 0 ORDER BY growth DESC, kind LIMIT 5", "snapshots")
def growing_types(v):
    return forecast.growing(v.snapshots)


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE GROUP BY event_type")
def ttl_cache(v):
    e = v.table("events")
    last = e.agg(F.max("ts")).first()[0]
    return e.filter(C("ts") > F.lit(last) - F.expr("interval 1800 seconds")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT seq, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, substr(sha256(file || ':' || line || ':' || description), 1, 16) || ':' || line AS fingerprint, regexp_replace(file, '^\\./', '') AS uri FROM findings""",
    "findings",
)
def sarif_results(v):
    level = F.when(C("severity").isin("critical", "high"), "error").when(C("severity") == "medium", "warning").otherwise("note")
    mark = F.concat(F.substring(F.sha2(F.concat_ws(":", "file", C("line").cast("string"), "description"), 256), 1, 16), F.lit(":"), "line")
    return v.findings.select("seq", level.alias("level"), mark.alias("fingerprint"), F.regexp_replace("file", r"^\./", "").alias("uri"))


@query(
    """SELECT type AS rule, min(seq) AS first_seq, min_by(CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END, seq) AS level FROM findings GROUP BY type""",
    "findings",
)
def sarif_rules(v):
    level = F.when(C("severity").isin("critical", "high"), "error").when(C("severity") == "medium", "warning").otherwise("note")
    return v.findings.groupBy(C("type").alias("rule")).agg(F.min("seq").alias("first_seq"), F.min_by(level, "seq").alias("level"))


@query("SELECT seq, substr(sha256('/repo/' || (seq % 40)), 1, 12) AS repo_hash FROM findings", "findings")
def repo_hashes(v):
    return v.findings.select("seq", F.substring(F.sha2(F.concat(F.lit("/repo/"), C("seq") % 40), 256), 1, 12).alias("repo_hash"))


@query("SELECT seq, 'fix/' || type || '-' || substr(regexp_extract(file, '([^/]*)\\.py$', 1), 1, 20) || '-20240301-1200' AS branch FROM findings", "findings")
def branch_names(v):
    stem = F.substring(F.regexp_extract("file", r"([^/]*)\.py$", 1), 1, 20)
    return v.findings.select("seq", F.concat(F.lit("fix/"), "type", F.lit("-"), stem, F.lit("-20240301-1200")).alias("branch"))


@query("SELECT seq, file || ':' || line AS breaking FROM findings WHERE severity IN ('high', 'critical')", "findings")
def breaking_changes(v):
    return v.findings.filter(C("severity").isin("high", "critical")).select("seq", F.concat("file", F.lit(":"), "line").alias("breaking"))


@query("SELECT o_orderpriority AS kind, count(*) AS n, avg((o_orderstatus = 'F')::INT) > 0.4 AS healthy FROM orders GROUP BY 1 ORDER BY 1")
def run_summary(v):
    return v.table("orders").groupBy(C("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), (F.avg((C("o_orderstatus") == "F").cast("double")) > 0.4).alias("healthy")).orderBy("kind")
