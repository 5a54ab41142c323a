"""Queries of records, look-ups and the run from findings to batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import records
from .catalogue import query
from .scoring import DEDUP

C = F.col


@query(f"WITH a AS (SELECT * FROM {dims.values_sql(records.ALTERNATIVES, 'type, choice, alternative, confidence')}) SELECT seq, choice::INT AS choice, alternative, a.confidence::INT AS confidence FROM findings JOIN a USING (type)", "findings")
def static_alternatives(v):
    return records.static_alternatives(v.findings.select("seq", "type")).select("seq", "choice", "alternative", "confidence")


RULES = """b AS (SELECT DISTINCT 'lib' || (p_partkey % 40) AS name, 'builtin' AS message, '' AS replacement, 'medium' AS severity, 80.0::DOUBLE AS priority FROM part),
c AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE ' lib' || (p_partkey % 60) || ' ' END AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE ' note ' || p_size END AS message, CASE WHEN p_partkey % 3 = 0 THEN 'CRITICAL ' END AS severity, CASE WHEN p_partkey % 5 = 0 THEN p_size::DOUBLE END AS priority FROM part)"""


@query(
    f"""WITH {RULES}, o AS (SELECT trim(name) AS name, trim(coalesce(message, trim(name) || ' is deprecated')) AS message, lower(trim(coalesce(severity, 'high'))) AS severity, coalesce(priority, 110) AS priority FROM c WHERE trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY trim(name) ORDER BY seq DESC) = 1)
SELECT name, message, severity, priority, true AS custom_rule FROM o UNION ALL SELECT name, message, severity, priority, false FROM b WHERE name NOT IN (SELECT name FROM o)"""
)
def rule_table(v):
    k = C("p_partkey")
    part = v.table("part")
    builtin = part.select(F.concat(F.lit("lib"), k % 40).alias("name"), F.lit("builtin").alias("message"), F.lit("").alias("replacement"), F.lit("medium").alias("severity"), F.lit(80.0).alias("priority")).distinct()
    custom = part.select(
        k.alias("seq"), F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" lib"), k % 60, F.lit(" "))).alias("name"), F.when(k % 4 != 0, F.concat(F.lit(" note "), "p_size")).alias("message"),
        F.lit(None).cast("string").alias("replacement"), F.when(k % 3 == 0, "CRITICAL ").alias("severity"), F.when(k % 5 == 0, C("p_size").cast("double")).alias("priority"),
    )
    return records.rule_table(builtin, custom).select("name", "message", "severity", "priority", "custom_rule")


@query(
    """WITH u AS (SELECT page_id, regexp_replace(url, '^http:', CASE WHEN page_id % 3 = 0 THEN 'http:' ELSE 'https:' END) AS url FROM pages), p AS (SELECT *, regexp_extract(url, '^(\\w+)://([^/?#:]+)(?::\\d+)?([^?#]*)', ['scheme', 'host', 'path']) AS x FROM u)
SELECT page_id, coalesce(x.scheme = 'https' AND lower(x.host) IN ('github.com', 'example.com', 'site1.example.com', 'gitlab.com') AND len(list_filter(string_split(x.path, '/'), lambda s: s <> '')) >= 2, false) AS allowed FROM p"""
)
def clone_urls(v):
    k = C("page_id")
    url = F.when(k % 3 == 0, C("url")).otherwise(F.regexp_replace("url", "^http:", "https:"))
    return v.table("pages").select("page_id", records.clone_allowed(url, ["github.com", "example.com", "site1.example.com", "gitlab.com"]).alias("allowed"))


@query("WITH s AS (SELECT id, max(seq) AS seq, max_by(status, seq) AS status FROM approvals GROUP BY id) SELECT id, seq FROM s WHERE status = 'pending'", "approvals")
def pending_approvals(v):
    from ..operators import ranking

    return records.pending(ranking.last_of(v.approvals, "id")).select("id", "seq")


@query("WITH d AS (SELECT max(cast(ts AS DATE)) AS day FROM events) SELECT event_id AS seq, event_type AS action FROM events, d WHERE cast(ts AS DATE) = day AND event_type = 'purchase' ORDER BY seq LIMIT 20")
def audit_entries(v):
    log = v.table("events").select(C("event_id").alias("seq"), C("event_type").alias("action"), "ts")
    day = log.agg(F.max(F.to_date("ts")).cast("string")).first()[0]
    return records.audit_query(log, day, "purchase", 20).select("seq", "action")


@query(
    """WITH c AS (SELECT o_orderkey // 4 AS plan, 'f' || (o_orderkey % 700) AS file, CASE WHEN o_orderkey % 7 > 0 THEN 'h' || (o_orderkey % 5) END AS sha FROM orders), n AS (SELECT DISTINCT 'f' || (o_orderkey % 700) AS file, 'h' || (o_orderkey % 700 % 5) AS now FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey < 700),
m AS (SELECT plan, coalesce(sha <> now, false) AS stale FROM c LEFT JOIN n USING (file)) SELECT plan, NOT bool_or(stale) AS passed, sum(stale::INT)::BIGINT AS n_stale FROM m GROUP BY plan"""
)
def stale_content(v):
    k = C("o_orderkey")
    o = v.table("orders")
    changes = o.select(F.floor(k / 4).cast("long").alias("plan"), F.concat(F.lit("f"), k % 700).alias("file"), F.when(k % 7 > 0, F.concat(F.lit("h"), k % 5)).alias("planned_sha"))
    now = o.filter((k % 3 > 0) & (k < 700)).select(F.concat(F.lit("f"), k % 700).alias("file"), F.concat(F.lit("h"), k % 700 % 5).alias("current_sha")).distinct()
    return records.stale_content(changes, now)


@query(
    """WITH t AS (SELECT 'team' || n_nationkey AS tenant, n_nationkey % 3 > 0 AS enabled, 'own' || n_nationkey AS settings FROM nation WHERE n_nationkey < 20), r AS (SELECT c_custkey AS seq, 'team' || c_nationkey AS tenant FROM customer)
SELECT seq, tenant, coalesce(enabled, true) AS enabled, coalesce(settings, 'default') AS settings FROM r LEFT JOIN t USING (tenant)"""
)
def tenant_settings(v):
    n = C("n_nationkey")
    tenants = v.table("nation").filter(n < 20).select(F.concat(F.lit("team"), n).alias("tenant"), (n % 3 > 0).alias("enabled"), F.concat(F.lit("own"), n).alias("settings"))
    return records.with_tenants(v.table("customer").select(C("c_custkey").alias("seq"), F.concat(F.lit("team"), "c_nationkey").alias("tenant")), tenants, "default").select("seq", "tenant", "enabled", "settings")


@query("SELECT o_orderkey AS run, o_orderkey % 3 = 0 AS success, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'error ' || o_orderkey % 3 END AS failure_reason FROM orders")
def run_records(v):
    k = C("o_orderkey")
    errors = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda x: x <= k % 3), lambda x: F.concat(F.lit("error "), k % 3 - x + 1))
    return records.run_records(v.table("orders").select(k.alias("run"), errors.alias("errors"))).select("run", "success", "failure_reason")


@query("SELECT l_orderkey AS run, count(*) AS n, sum((l_returnflag <> 'R')::INT)::BIGINT AS fixed, 100.0::DOUBLE * sum((l_returnflag <> 'R')::INT) / count(*) AS success_rate FROM lineitem GROUP BY 1")
def execution_rates(v):
    return records.execution_rate(v.table("lineitem").select(C("l_orderkey").alias("run"), (C("l_returnflag") != "R").alias("success")))


@query("SELECT count(*) AS total, sum((seq % 3 = 0)::INT)::BIGINT AS reachable, sum((seq % 15 = 0)::INT)::BIGINT AS entry_points FROM findings", "findings")
def reach_summary(v):
    s = C("seq")
    return records.reach_summary(v.findings.select((s % 3 == 0).alias("reachable"), F.when(s % 15 == 0, "entry-point").otherwise("other").alias("tag")))


@query(
    """WITH s AS (SELECT l_orderkey AS migration, list_transform(range((l_quantity % 7)::INT), lambda i: 'f' || (l_partkey + i) % 9) AS files, ['c' || l_suppkey % 4] AS changed FROM lineitem),
d AS (SELECT migration, count(DISTINCT file) AS distinct_files FROM (SELECT migration, unnest(list_concat(files, changed)) AS file FROM s) GROUP BY 1), m AS (SELECT migration, count(*) AS n_stages, sum(len(files))::BIGINT AS n_files FROM s GROUP BY 1)
SELECT migration, n_stages, n_files, distinct_files, CASE WHEN n_stages <= 2 AND n_files <= 5 THEN 'simple' WHEN n_stages > 5 OR n_files > 20 THEN 'expert-only' ELSE 'complex' END AS complexity FROM m JOIN d USING (migration)"""
)
def migration_size(v):
    n = (C("l_quantity") % 7).cast("int")
    files = F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < n), lambda i: F.concat(F.lit("f"), (C("l_partkey") + i) % 9))
    return records.migration_size(v.table("lineitem").select(C("l_orderkey").alias("migration"), files.alias("files"), F.array(F.concat(F.lit("c"), C("l_suppkey") % 4)).alias("changed")))


@query("SELECT o_orderkey AS repo, CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 4 = 1 THEN 'security_first' WHEN o_orderkey % 400 > 200 THEN 'deprecations_first' ELSE 'full_scan' END AS template FROM orders")
def template_choice(v):
    k = C("o_orderkey")
    frameworks = F.when(k % 4 == 1, F.array(F.lit("flask"), F.lit("django"))).otherwise(F.array(F.lit("flask")))
    return records.template(v.table("orders").select(k.alias("repo"), (C("o_custkey") % 5 == 0).cast("int").alias("n_sensitive"), frameworks.alias("frameworks"), (k % 400).alias("python_files"))).select("repo", "template")


@query("SELECT event_id AS seq, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_notifications(v):
    return records.newest(v.table("events").select(C("event_id").alias("seq"), "event_type", "ts"), 50).select("seq", "event_type")


@query("SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, l_partkey)::INT AS rank FROM lineitem QUALIFY rank <= 10")
def file_history(v):
    rows = v.table("lineitem").select(C("l_suppkey").alias("file"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("seq"), C("l_shipdate").alias("ts"))
    return records.newest(rows, 10, "file").select("file", "seq", "rank")


CUT = """head0 AS (SELECT doc_id, text, substr(text, 1, 300) AS h, right(text, 150) AS t FROM documents),
parts AS (SELECT doc_id, text, CASE WHEN instr(reverse(h), chr(10)) > 0 AND instr(reverse(h), chr(10)) < length(h) THEN left(h, length(h) - instr(reverse(h), chr(10))) ELSE h END AS head, CASE WHEN instr(t, chr(10)) > 1 THEN substr(t, instr(t, chr(10)) + 1) ELSE t END AS tail FROM head0)"""


@query(f"WITH {CUT} SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE head || chr(10) || chr(10) || '    # ... (' || (length(text) - length(head) - length(tail)) || ' chars truncated) ...' || chr(10) || chr(10) || tail END) AS shortened_md5 FROM parts")
def shortened_context(v):
    return v.table("documents").select("doc_id", F.md5(records.shortened(C("text"), 500).cast("binary")).alias("shortened_md5"))


@query(
    """WITH r AS (SELECT 'F' || (l_orderkey % 900) AS finding_id, min(l_shipdate) AS done FROM lineitem WHERE l_linenumber = 7 GROUP BY 1)
SELECT seq, CASE WHEN seq % 11 = 0 THEN DATE '1990-01-01' ELSE cast(done AS DATE) END AS resolved_on FROM findings LEFT JOIN r ON finding_id = 'F' || seq""",
    "findings",
)
def marked_resolved(v):
    store = v.findings.select("seq", F.concat(F.lit("F"), "seq").alias("finding_id"), F.when(C("seq") % 11 == 0, F.lit("1990-01-01").cast("date")).alias("resolved_at"))
    done = v.table("lineitem").filter("l_linenumber = 7").select(F.concat(F.lit("F"), C("l_orderkey") % 900).alias("finding_id"), C("l_shipdate").cast("date").alias("resolved_at"))
    return records.mark_resolved(store, done).select("seq", C("resolved_at").alias("resolved_on"))


@query(
    """WITH i AS (SELECT s_suppkey AS number, CASE WHEN s_suppkey % 2 = 0 THEN '[Proposal] ' ELSE '' END || 'Finding in module ' || (s_suppkey % 12) || ' soon' AS title, CASE WHEN s_suppkey % 3 > 0 THEN 'open' ELSE 'closed' END AS state FROM supplier),
b AS (SELECT DISTINCT left(description, 40) AS beginning FROM findings), m AS (SELECT beginning, min(number) AS duplicate FROM b JOIN i ON contains(title, beginning) WHERE state = 'open' AND starts_with(title, '[Proposal]') GROUP BY 1)
SELECT seq, duplicate FROM findings LEFT JOIN m ON beginning = left(description, 40)""",
    "findings",
)
def open_proposals(v):
    k = C("s_suppkey")
    title = F.concat(F.when(k % 2 == 0, "[Proposal] ").otherwise(""), F.lit("Finding in module "), k % 12, F.lit(" soon"))
    issues = v.table("supplier").select(k.alias("number"), title.alias("title"), F.when(k % 3 > 0, "open").otherwise("closed").alias("state"))
    return records.open_proposals(v.findings.select("seq", "description"), issues).select("seq", "duplicate")


@query("SELECT seq, array_to_string(list_sort(list_distinct(['**/auth/**', '**/p' || seq % 5 || '/**', '**/p' || seq % 3 || '/**'])), ',') AS paths FROM findings", "findings")
def merged_paths(v):
    glob = lambda n: F.concat(F.lit("**/p"), C("seq") % n, F.lit("/**"))
    return v.findings.select("seq", F.array_join(records.merged_paths(F.array(F.lit("**/auth/**"), glob(5)), F.array(glob(3))), ",").alias("paths"))


@query("WITH m AS (SELECT doc_id, 'app.' || CASE doc_id % 5 WHEN 0 THEN 'tests' WHEN 1 THEN 'test_a' WHEN 2 THEN 'conftest' WHEN 3 THEN 'contest' ELSE 'attest_b' END || '.x' AS module FROM documents) SELECT doc_id, doc_id % 5 < 3 AS is_test FROM m")
def test_modules(v):
    d = C("doc_id")
    name = F.when(d % 5 == 0, "tests").when(d % 5 == 1, "test_a").when(d % 5 == 2, "conftest").when(d % 5 == 3, "contest").otherwise("attest_b")
    return v.table("documents").select("doc_id", records.is_test_module(F.concat(F.lit("app."), name, F.lit(".x"))).alias("is_test"))


@query("SELECT o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN 'explain' WHEN 1 THEN 'retry' WHEN 2 THEN 'approve' WHEN 3 THEN 'reject' WHEN 4 THEN 'smaller' END AS command FROM orders")
def review_commands(v):
    k = C("o_orderkey")
    body = F.when(k % 6 == 0, "@bot explain this").when(k % 6 == 1, "/RETRY").when(k % 6 == 2, " LGTM ").when(k % 6 == 3, "won't fix").when(k % 6 == 4, "please\n@bot Smaller steps").otherwise("thanks, approve of this")
    return v.table("orders").select(k.alias("seq"), records.review_command(body).alias("command"))


@query(
    """SELECT o_orderkey AS seq, 'plan ' || o_orderkey || '; ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Review AI reasoning: r' ELSE 'Review changes manually' END || '; Run tests after applying changes' AS steps,
  'Confidence score: ' || (o_orderkey % 10) || '/10' || CASE WHEN o_orderkey % 3 > 0 THEN '; Risk level: high' ELSE '' END AS risks FROM orders"""
)
def proposal_records(v):
    k = C("o_orderkey")
    plans = v.table("orders").select(k.alias("seq"), F.concat(F.lit("plan "), k).alias("summary"), F.when(k % 2 == 0, "r").otherwise("").alias("reasoning"), (k % 10).alias("confidence"), F.when(k % 3 > 0, "high").otherwise("low").alias("risk"))
    return records.proposal(plans).select("seq", F.array_join("steps", "; ").alias("steps"), F.array_join("risks", "; ").alias("risks"))


@query(
    """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 > 0 THEN 'Review suggested refactoring: s; ' ELSE '' END || 'Modify a.py: see diff; Modify b' || (o_orderkey % 4) || '.py: rename' || CASE WHEN o_orderkey % 2 = 0 THEN '; AI reasoning: r' ELSE '' END AS steps,
  'Low confidence (' || (o_orderkey % 5) || '/10)' || CASE WHEN o_orderkey % 3 = 0 THEN '; Involves function signature changes' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '; Requires manual verification' ELSE '' END AS risks FROM orders"""
)
def downgraded_plans(v):
    k = C("o_orderkey")
    change = lambda f, w: F.struct(f.alias("file"), F.lit(w).alias("what"))
    changes = F.array(change(F.lit("a.py"), ""), change(F.concat(F.lit("b"), k % 4, F.lit(".py")), "rename"))
    plans = v.table("orders").select(k.alias("seq"), F.when(k % 5 > 0, "s").otherwise("").alias("summary"), F.when(k % 2 == 0, "r").otherwise("").alias("reasoning"), (k % 5).alias("confidence"), changes.alias("changes"), (k % 3 == 0).alias("changes_signature"), (k % 7 == 0).alias("manual"))
    return records.downgraded(plans).select("seq", F.array_join("steps", "; ").alias("steps"), F.array_join("risks", "; ").alias("risks"))


@query(
    """WITH o AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'merged' WHEN 1 THEN 'rejected' WHEN 2 THEN 'modified' ELSE 'other' END AS outcome, ['m1', 'm2', 'm3', 'm4'][1:(seq % 5)::INT] AS ms FROM findings)
SELECT seq, regexp_replace(file, '/[^/]*$', '') AS file_pattern, outcome = 'merged' AS success, CASE WHEN outcome = 'merged' AND len(ms) = 0 THEN 'Approach was accepted without changes — use same strategy' WHEN outcome = 'merged' THEN 'Accepted with modifications: ' || array_to_string(ms[1:3], ', ')
  WHEN outcome = 'rejected' THEN 'Approach was rejected — try alternative strategy' WHEN outcome = 'modified' THEN 'Required changes: ' || CASE WHEN len(ms) > 0 THEN array_to_string(ms[1:3], ', ') ELSE 'style adjustments' END ELSE '' END AS recommendation FROM o""",
    "findings",
)
def outcome_records(v):
    s = C("seq")
    outcome = F.when(s % 4 == 0, "merged").when(s % 4 == 1, "rejected").when(s % 4 == 2, "modified").otherwise("other")
    rows = v.findings.select("seq", "file", outcome.alias("outcome"), F.slice(F.array(*map(F.lit, ["m1", "m2", "m3", "m4"])), F.lit(1), (s % 5).cast("int")).alias("modifications"))
    return records.outcome_record(rows).select("seq", "file_pattern", "success", "recommendation")


@query(
    """WITH p AS (SELECT p_partkey AS playbook, unnest(range((p_size % 4)::INT)) AS ord FROM part)
SELECT playbook, ord::INT AS ord, 'step-' || (ord + 1) AS stage, 'Replace: a' || ord || ' → b' || ord AS description, CASE WHEN ord > 0 THEN 'step-' || ord END AS depends_on FROM p"""
)
def playbook_stages(v):
    pair = lambda i: F.struct(F.concat(F.lit("a"), i).alias("pattern"), F.concat(F.lit("b"), i).alias("replacement"))
    patterns = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < C("p_size") % 4), pair)
    return records.playbook_stages(v.table("part").select(C("p_partkey").alias("playbook"), patterns.alias("patterns")))


@query("SELECT type, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM findings GROUP BY type", "findings")
def fallback_stage(v):
    return records.single_stage(v.findings, "type").select("type", F.array_join("files", ",").alias("files"))


@query("SELECT event_id FROM events WHERE ts < (SELECT cast(max(cast(ts AS DATE)) AS TIMESTAMP) FROM events) - INTERVAL 7 DAY")
def expired_backups(v):
    rows = v.table("events").select("event_id", C("ts").alias("mtime"))
    return records.expired_backups(rows, rows.agg(F.max(F.to_date("mtime")).cast("string")).first()[0], 7).select("event_id")


@query("WITH m AS (SELECT max(cast(ts AS DATE))::TIMESTAMP AS t FROM events), k AS (SELECT unnest(['purchase', 'error', 'forecast']) AS kind), n AS (SELECT event_type AS kind, count(*) AS n FROM events, m WHERE epoch(t) - floor(epoch(ts)) < 86400 GROUP BY 1) SELECT kind, coalesce(n, 0) AS n FROM k LEFT JOIN n USING (kind)")
def cache_sizes(v):
    rows = v.table("events").select(C("event_type").alias("kind"), C("ts").alias("stored_at"))
    return records.cache_sizes(rows, rows.agg(F.max(F.to_date("stored_at")).cast("string")).first()[0], 86_400, ["purchase", "error", "forecast"])


@query(
    f"""WITH {DEDUP}, s AS (SELECT * FROM dd WHERE dedup_key NOT IN (SELECT dedup_key FROM kd WHERE seq % 7 = 0)), p AS (SELECT *, row_number() OVER (ORDER BY priority_score + business_impact_score DESC, seq) AS position, regexp_replace(file, '/[^/]*$', '') AS folder FROM s),
b AS (SELECT *, min(position) OVER (PARTITION BY folder) AS ff, (row_number() OVER (PARTITION BY folder ORDER BY position) - 1) // 5 AS part FROM p), h AS (SELECT ff, part, row_number() OVER (ORDER BY ff, part)::INT AS batch FROM (SELECT DISTINCT ff, part FROM b))
SELECT seq, dedup_key, position, folder, batch FROM b JOIN h USING (ff, part) WHERE batch <= 5""",
    "findings",
)
def pipeline_run(v):
    from ..operators import ranking

    seen = v.findings.filter("seq % 7 = 0").select(ranking.dedup_key().alias("dedup_key")).distinct()
    return records.run_pipeline(v.findings, seen)
