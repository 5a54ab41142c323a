"""Queries over graphs and over structured text (reports, replies, settings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code, graph
from ..sources import formats
from .catalogue import query

C = F.col

REACH = """WITH RECURSIVE back(node, hop) USING KEY (node) AS (SELECT * FROM (VALUES (1, 0), (31, 0)) AS t(a, b)
  UNION SELECT e.src, min(b.hop) + 1 FROM edges e JOIN back b ON e.dst = b.node WHERE e.src NOT IN (SELECT node FROM recurring.back) GROUP BY e.src),
least AS (SELECT node, hop FROM back)"""


@query(f"{REACH} SELECT node::INT AS node, hop::INT AS hop FROM least", "edges")
def blast_nodes(v):
    e = v.edges.select(C("dst").alias("src"), C("src").alias("dst"))
    return graph.reach(e, graph.frame(v.spark, [1, 31]))


@query(
    f"""{REACH}, s AS (SELECT sum((hop = 1)::INT)::BIGINT AS direct, sum((hop > 1)::INT)::BIGINT AS transitive, count(*) AS affected FROM least), m AS (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges)), r AS (SELECT *, round(affected / (SELECT n FROM m)::DOUBLE, 4) AS radius FROM s)
SELECT *, CASE WHEN radius > 0.3 THEN 'critical' WHEN radius > 0.15 THEN 'high' WHEN radius > 0.05 THEN 'medium' ELSE 'low' END AS risk, radius <= 0.3 AS gate_passed FROM r""",
    "edges",
)
def blast_radius(v):
    return graph.blast_radius(v.edges, graph.frame(v.spark, [1, 31]))


@query(
    """WITH RECURSIVE walk(entry, node, path) AS (SELECT a, a, [a] FROM (VALUES (2), (23), (45)) AS t(a) UNION ALL SELECT w.entry, e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst))
SELECT entry::INT AS entry, node::INT AS node, array_to_string(path, '>') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY entry, node ORDER BY len(path), list_reverse(path)) AS rn FROM walk) WHERE rn = 1""",
    "edges",
)
def reachability(v):
    paths = graph.shortest_paths(v.edges, graph.frame(v.spark, [2, 23, 45]))
    return paths.select("entry", "node", F.array_join(C("path").cast("array<string>"), ">").alias("chain"))


@query(
    """WITH RECURSIVE entry(place, node, framework) AS (SELECT row_number() OVER (ORDER BY s_suppkey), s_suppkey * 97, CASE s_suppkey % 3 WHEN 0 THEN 'flask' WHEN 1 THEN 'fastapi' ELSE 'django' END FROM supplier),
met(place, node) AS (SELECT place, node FROM entry UNION SELECT m.place, e.dst FROM met m JOIN edges e ON e.src = m.node),
first AS (SELECT m.node, min_by(framework, m.place) AS framework, count(*) AS n FROM met m JOIN entry USING (place) GROUP BY m.node)
SELECT seq, first.node IS NOT NULL AS reachable, coalesce(framework, 'unknown') AS framework, coalesce(n, 0) AS entry_points FROM (SELECT o_orderkey AS seq FROM orders) LEFT JOIN first ON first.node = seq""",
    "edges",
)
def reaching_frameworks(v):
    k = C("s_suppkey")
    entries = v.table("supplier").select(k.alias("place"), (k * 97).cast("int").alias("node"), F.when(k % 3 == 0, "flask").when(k % 3 == 1, "fastapi").otherwise("django").alias("framework"))
    findings = v.table("orders").select(C("o_orderkey").alias("seq"), C("o_orderkey").cast("int").alias("node"))
    return code.reaching_framework(v.edges, entries, findings).select("seq", "reachable", "framework", "entry_points")


@query(
    """WITH RECURSIVE walk(first, tip, path) AS (SELECT src, dst, [src, dst] FROM edges WHERE src < dst UNION ALL SELECT w.first, e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.tip WHERE e.dst > w.first AND NOT list_contains(w.path, e.dst))
SELECT DISTINCT array_to_string(list_sort(path), ',') AS members, len(path)::INT AS size FROM walk w JOIN edges e ON e.src = w.tip AND e.dst = w.first""",
    "edges",
)
def circular_deps(v):
    return graph.cycles(v.edges).select(F.array_join(C("members").cast("array<string>"), ",").alias("members"), F.size("members").alias("size"))


DAG = "dag AS (SELECT DISTINCT greatest(src, dst) AS src, least(src, dst) AS dst FROM edges), nds AS (SELECT DISTINCT o_orderkey::INT AS node FROM orders)"


def dag(v):
    return v.edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def stages(v):
    return v.table("orders").select(C("o_orderkey").cast("int").alias("node")).distinct()


@query(
    f"""WITH RECURSIVE {DAG}, lv(node, level) AS (SELECT node, 0 FROM nds UNION SELECT d.src, l.level + 1 FROM dag d JOIN lv l ON d.dst = l.node) SELECT node::INT AS node, max(level)::INT AS level FROM lv GROUP BY node""",
    "edges",
)
def stage_levels(v):
    return graph.levels(dag(v), stages(v))


@query(
    f"""WITH RECURSIVE {DAG}, hit(node, hop) AS (SELECT node, 0 FROM nds WHERE node % 30 = 3 UNION SELECT d.src, 1 FROM dag d JOIN hit h ON d.dst = h.node), s AS (SELECT node, max(hop) AS hop, min(hop) AS lo FROM hit GROUP BY node)
SELECT node, CASE WHEN lo = 0 THEN 'failed' WHEN hop > 0 THEN 'rolled_back' ELSE 'completed' END AS status FROM nds LEFT JOIN s USING (node)""",
    "edges",
)
def stage_cascade(v):
    return graph.cascade(dag(v), stages(v).filter("node % 30 = 3"), stages(v))


@query(
    """WITH t AS (SELECT event_id, '{"results": [{"filename": "f' || (user_id % 9) || '.py", "line_number": ' || user_id || ', "issue_severity": "' || CASE user_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END || '"}]}' AS j FROM events)
SELECT event_id, 'f' || (user_id % 9) || '.py' AS file, user_id::INT AS line, CASE user_id % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'critical' END AS severity, CASE user_id % 3 WHEN 0 THEN 80.0 WHEN 1 THEN 140.0 ELSE 180.0 END::DOUBLE AS priority FROM events"""
)
def scanner_report(v):
    u = C("user_id")
    text = F.concat(F.lit('{"results": [{"filename": "f'), u % 9, F.lit('.py", "line_number": '), u, F.lit(', "issue_severity": "'), F.when(u % 3 == 0, "LOW").when(u % 3 == 1, "MEDIUM").otherwise("HIGH"), F.lit('"}]}'))
    return formats.issue_report(v.table("events").select("event_id", text.alias("report"))).select("event_id", "file", "line", "severity", "priority")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events")
def json_default(v):
    return v.table("events").select("event_id", formats.json_number("props", "$.k", 0.0).alias("k"))


@query(
    """SELECT doc_id, 'src/a' || (doc_id % 7) || '.py' AS file, (doc_id % 90)::INT AS line, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'note' END AS severity, 'message: ' || doc_id AS message FROM documents WHERE doc_id % 3 <> 0"""
)
def type_check_report(v):
    d = C("doc_id")
    text = F.when(d % 3 == 0, "Success: no issues").otherwise(F.concat(F.lit("src/a"), d % 7, F.lit(".py:"), d % 90, F.lit(": "), F.when(d % 2 == 0, "error").otherwise("note"), F.lit(": message: "), d))
    return formats.colon_report(v.table("documents").select("doc_id", text.alias("text"))).select("doc_id", "file", "line", "severity", "message")


@query(
    """SELECT doc_id, greatest(1, least(10, doc_id % 14))::INT AS confidence, CASE WHEN doc_id % 4 = 0 THEN 'medium' ELSE 'high' END AS risk, 'plan ' || doc_id AS summary FROM documents"""
)
def plan_replies(v):
    d = C("doc_id")
    text = F.concat(F.lit('Sure!\n```json\n{"summary": "plan '), d, F.lit('", "confidence_score": '), d % 14, F.lit(', "risk_level": "'), F.when(d % 4 == 0, "odd").otherwise("high"), F.lit('"}\n```\nDone'))
    return formats.plan_reply(v.table("documents").select("doc_id", text.alias("reply"))).select("doc_id", "confidence", "risk", "summary")


@query("SELECT o_orderkey AS pr, 'F' || (o_orderkey % 999) AS finding_id, (o_orderkey % 10)::INT AS confidence FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'pr-' || o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 0")
def pr_bodies(v):
    k = C("o_orderkey")
    body = F.when(k % 4 == 0, "free text").otherwise(F.concat(F.lit("Finding ID: F"), k % 999, F.lit("\nType: security\nConfidence: "), k % 10, F.lit("/10")))
    return formats.pr_body(v.table("orders").select(k.alias("pr"), body.alias("body"))).select("pr", "finding_id", "confidence")


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'team_lead' WHEN 1 THEN 'viewer' WHEN 2 THEN 'security_admin' ELSE 'developer' END AS role FROM customer"""
)
def claims_roles(v):
    k = C("c_custkey")
    claims = F.when(k % 4 == 0, F.array(F.lit("guest"), F.lit("Team-Lead"), F.lit("viewer"))).when(k % 4 == 1, F.array(F.lit("nobody"))).when(k % 4 == 2, F.array(F.lit("Security Admin"), F.lit("developer"))).otherwise(F.array(F.lit("DEVELOPER")))
    return formats.first_role(v.table("customer").select(k.alias("id"), claims.alias("claims"))).select("id", "role")


@query(
    """WITH f AS (SELECT DISTINCT CASE doc_id % 6 WHEN 0 THEN 'pyproject.toml' WHEN 1 THEN 'package.json' WHEN 2 THEN '.github/workflows/ci.yml' WHEN 3 THEN 'src/auth/a.py' WHEN 4 THEN 'lib/payments/b.js' ELSE 'c.go' END AS path, doc_id % 3 AS repo FROM documents)
SELECT repo, CASE WHEN path = 'pyproject.toml' THEN 'manager:pip' WHEN path = 'package.json' THEN 'manager:npm' ELSE 'ci:github-actions' END AS fact FROM f WHERE path IN ('pyproject.toml', 'package.json') OR starts_with(path, '.github/workflows/')
UNION ALL SELECT repo, CASE WHEN contains(path, 'auth') THEN 'sensitive:**/auth/**' ELSE 'sensitive:**/payments/**' END FROM f WHERE contains(path, '/auth/') OR contains(path, '/payments/')
UNION ALL SELECT repo, 'language:' || CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.js') THEN 'javascript' ELSE 'go' END FROM f WHERE ends_with(path, '.py') OR ends_with(path, '.js') OR ends_with(path, '.go')"""
)
def project_facts(v):
    d = C("doc_id")
    path = F.when(d % 6 == 0, "pyproject.toml").when(d % 6 == 1, "package.json").when(d % 6 == 2, ".github/workflows/ci.yml").when(d % 6 == 3, "src/auth/a.py").when(d % 6 == 4, "lib/payments/b.js").otherwise("c.go")
    return formats.project_facts(v.table("documents").select((d % 3).alias("repo"), path.alias("path")).distinct())


@query("SELECT doc_id, len(regexp_extract_all(text, 'the'))::INT AS n, len(regexp_extract_all(text, 'the')) = 1 AS replaceable FROM documents")
def replace_precondition(v):
    return formats.occurrences(v.table("documents").select("doc_id", "text"), "the").select("doc_id", "n", "replaceable")


TOOL_FILES = """files AS (SELECT doc_id % 50 AS repo, CASE doc_id % 7 WHEN 0 THEN 'pyproject.toml' WHEN 1 THEN 'tests/conftest.py' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'a/x_test.go' WHEN 4 THEN 'src/m' || doc_id || '.py' WHEN 5 THEN 'package.json' ELSE 'setup.cfg' END AS path,
  CASE doc_id % 4 WHEN 0 THEN '[tool.ruff] django' WHEN 1 THEN '"mocha" [pylint -> ' WHEN 2 THEN '[tool.mypy] pytest' ELSE 'x' END AS text FROM documents)"""


def tool_files(v):
    d = C("doc_id")
    path = F.when(d % 7 == 0, "pyproject.toml").when(d % 7 == 1, "tests/conftest.py").when(d % 7 == 2, "go.mod").when(d % 7 == 3, "a/x_test.go").when(d % 7 == 4, F.concat(F.lit("src/m"), d, F.lit(".py"))).when(d % 7 == 5, "package.json").otherwise("setup.cfg")
    text = F.when(d % 4 == 0, "[tool.ruff] django").when(d % 4 == 1, '"mocha" [pylint -> ').when(d % 4 == 2, "[tool.mypy] pytest").otherwise("x")
    return v.table("documents").select((d % 50).alias("repo"), path.alias("path"), text.alias("text"))


@query(
    f"""WITH {TOOL_FILES}, t AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if x is None else "'" + x + "'" for x in row) + ")" for row in formats.TOOLS)}) AS t(kind, name, file, marker))
SELECT DISTINCT repo, kind, name FROM files JOIN t ON path = file AND (marker IS NULL OR contains(text, marker))
UNION SELECT repo, 'test', 'go-test' FROM files GROUP BY repo HAVING bool_or(path = 'go.mod') AND bool_or(ends_with(path, '_test.go'))"""
)
def project_tools(v):
    return formats.project_tools(tool_files(v))


@query(f"WITH {TOOL_FILES}, p AS (SELECT * FROM files WHERE ends_with(path, '.py') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 10) SELECT repo, bool_or(contains(text, '-> ') OR contains(text, ': str') OR contains(text, ': int')) AS typed FROM p GROUP BY repo")
def typed_projects(v):
    return formats.typed_project(tool_files(v))


@query(f"WITH {TOOL_FILES} SELECT repo, CASE WHEN ends_with(path, '.py') THEN 'python' ELSE 'go' END AS language, count(*) AS n FROM files WHERE ends_with(path, '.py') OR ends_with(path, '.go') GROUP BY ALL")
def language_counts(v):
    return formats.language_counts(tool_files(v))
