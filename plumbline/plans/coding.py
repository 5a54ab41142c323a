"""Queries over parsed source text, tool reports, replies and prompt texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code, reports
from ..sources import files, formats, runs, sinks
from .catalogue import query

C = F.col


def sources(v):
    """One module for each supplier: every function calls that of half its number, each tenth is a route."""
    k = C("s_suppkey")
    mark = F.when(k % 10 == 0, "@app.get").otherwise("")
    half = F.floor(k / 2).cast("string")
    text = F.concat(F.lit("import pkg"), k % 7, F.lit(".core\n"), mark, F.lit("\ndef f"), k, F.lit("(a, b: int = 0):\n    return f"), half, F.lit("(a)\n"))
    return v.table("supplier").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), text.alias("text"))


CHAINS = """RECURSIVE r(k, chain) AS (SELECT s_suppkey, ['f' || s_suppkey] FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT k // 2, list_append(chain, 'f' || (k // 2)) FROM r WHERE k >= 2),
n AS (SELECT k, len(chain) AS size, chain FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(chain), list_reverse(chain)) = 1)"""


@query(
    f"""WITH {CHAINS}, q AS (SELECT o_orderkey AS seq, o_custkey % 100 + 1 AS k, (o_orderkey % 7 + 1)::INT AS line, (o_orderkey % 200)::DOUBLE AS p FROM orders),
m AS (SELECT q.*, CASE WHEN s_suppkey IS NOT NULL AND line IN (3, 4) THEN 'f' || q.k END AS enclosing, chain FROM q LEFT JOIN supplier ON s_suppkey = q.k LEFT JOIN n ON n.k = q.k)
SELECT seq, enclosing, CASE WHEN enclosing IS NOT NULL THEN array_to_string(chain, '>') END AS call_chain, CASE WHEN enclosing IS NOT NULL THEN chain IS NOT NULL END AS reachable,
  CASE WHEN enclosing IS NOT NULL AND chain IS NOT NULL THEN least(200, p * 1.1::DOUBLE) ELSE p END::DOUBLE AS priority_score FROM m"""
)
def function_reachability(v):
    k = C("o_orderkey")
    findings = v.table("orders").select(k.alias("seq"), F.concat(F.lit("m"), C("o_custkey") % 100 + 1, F.lit(".py")).alias("file"), (k % 7 + 1).cast("int").alias("line"), (k % 200).cast("double").alias("priority_score"))
    found = code.with_reachability(findings, files.syntax_facts(sources(v)))
    return found.select("seq", "enclosing", F.array_join("call_chain", ">").alias("call_chain"), "reachable", "priority_score")


@query("SELECT DISTINCT 'm' || s_suppkey AS src, 'pkg' || (s_suppkey % 7) AS dst FROM supplier")
def import_graph(v):
    return files.import_edges(files.syntax_facts(sources(v)))


FRAMEWORKS = [
    ("flask", "f()", "@app.route('/')\ndef f():\n    pass\n"),
    ("fastapi", "g()", "@router.get('/')\ndef g():\n    pass\n"),
    ("django", "class V", "class V(views.APIView):\n    pass\n"),
    ("lambda", "handler(event, context)", "def handler(event, context):\n    pass\n"),
    ("main", 'if __name__ == "__main__"', "if __name__ == '__main__':\n    pass\n"),
    ("", "", "@router.get('/')\nasync def h():\n    pass\n"),
]


def chosen(items, column):
    out = None
    for i, x in enumerate(items):
        out = F.when(column == i, x) if out is None else out.when(column == i, x)
    return out


@query("SELECT 'm' || s_suppkey || '.py' AS path, " + ", ".join("CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{x[n]}'" for i, x in enumerate(FRAMEWORKS)) + f" END AS {name}" for n, name in enumerate(("framework", "detail"))) + " FROM supplier WHERE s_suppkey % 6 < 5")
def framework_entry_points(v):
    k = C("s_suppkey")
    texts = v.table("supplier").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), chosen([x[2] for x in FRAMEWORKS], k % 6).alias("text"))
    return code.framework_entries(files.syntax_facts(texts))


@query("SELECT 'm' || s_suppkey || '.py' AS path, 'pkg' || (s_suppkey % 7) || '.core' AS name FROM supplier WHERE s_suppkey % 7 NOT IN (1, 2, 5)")
def unavailable_imports(v):
    known = v.spark.createDataFrame([("pkg1",), ("pkg2",), ("pkg5",)], "module string")
    return code.missing_imports(files.syntax_facts(sources(v)), known)


@query("SELECT event_id, 'f' || (user_id % 9) || '.py' AS file, user_id::INT AS line, 'E' || (user_id % 13) AS code FROM events")
def lint_violations(v):
    u = C("user_id")
    report = F.concat(F.lit('[{"filename": "f'), u % 9, F.lit('.py", "code": "E'), u % 13, F.lit('", "location": {"row": '), u, F.lit(', "column": 1}, "message": "m"}]'))
    return formats.lint_report(v.table("events").select("event_id", report.alias("report"))).select("event_id", "file", "line", "code")


@query("SELECT 'p' || p_partkey AS name, p_size || '.0' AS version, 'V-' || p_partkey || '-' || n AS id, CASE WHEN p_size % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM part, (SELECT unnest([1, 2]) AS n) WHERE n <= p_partkey % 3")
def audit_vulnerabilities(v):
    k, n = C("p_partkey"), C("p_size")
    fix = F.when(n % 2 == 0, '["9"]').otherwise("[]")
    weak = lambda i: F.concat(F.lit('{"id": "V-'), k, F.lit(f'-{i}", "fix_versions": '), fix, F.lit("}"))
    list_ = F.when(k % 3 == 0, "").when(k % 3 == 1, weak(1)).otherwise(F.concat_ws(", ", weak(1), weak(2)))
    report = F.concat(F.lit('{"dependencies": [{"name": "p'), k, F.lit('", "version": "'), n, F.lit('.0", "vulns": ['), list_, F.lit("]}]}"))
    return formats.audit_report(v.table("part").select(report.alias("report")))


@query("SELECT o_orderkey AS seq, n::INT AS pos, CASE n WHEN 0 THEN 'a' ELSE 'b' END || o_custkey AS name, (o_orderkey % 10 + n)::INT AS confidence FROM orders, (SELECT unnest([0, 1]) AS n) WHERE o_orderkey % 4 <> 3")
def reply_alternatives(v):
    k, c = C("o_orderkey"), C("o_custkey")
    item = lambda letter, n: F.concat(F.lit(f'{{"name": "{letter}'), c, F.lit('", "confidence": '), k % 10 + n, F.lit("}"))
    reply = F.when(k % 4 == 3, "no list here").otherwise(F.concat(F.lit("Here it is:\n["), item("a", 0), F.lit(",\n"), item("b", 1), F.lit("]\nDone.")))
    rows = v.table("orders").select(k.alias("seq"), reply.alias("reply"))
    return formats.reply_list(rows, "struct<name:string,confidence:int>").select("seq", "pos", "item.*")


@query("SELECT 'f' || (o_custkey % 300) AS uri, count(*) AS n_results, '2.1.0' AS version, 'T' || min(o_orderkey) AS first_fingerprint FROM (SELECT o_custkey, printf('%012d', o_orderkey) AS o_orderkey FROM orders) GROUP BY 1")
def sarif_documents(v):
    k = C("o_orderkey")
    seq = F.format_string("T%012d", k)
    rows = v.table("orders").select(F.lit("r").alias("rule"), F.lit("error").alias("level"), F.concat(F.lit("f"), C("o_custkey") % 300).alias("uri"), F.lit(1).alias("line"), F.lit("m").alias("message"), seq.alias("fingerprint"))
    shape = "version string, runs array<struct<results:array<struct<fingerprints:struct<primary:string>>>>>"
    d = sinks.sarif(rows).select("uri", F.from_json("document", shape).alias("d"))
    marks = C("d.runs")[0]["results"]["fingerprints"]["primary"]
    return d.select("uri", F.size(marks).cast("long").alias("n_results"), C("d.version").alias("version"), F.array_min(marks).alias("first_fingerprint"))


TITLE = "Preferences (follow these):"


@query(f"SELECT team, '{TITLE}' || chr(10) || string_agg('  ' || n || '. ' || preference, chr(10) ORDER BY n) AS prompt FROM (SELECT team, preference, row_number() OVER (PARTITION BY team ORDER BY seq) AS n FROM prefs) GROUP BY team", "prefs")
def preference_prompt(v):
    return code.prompt_list(v.prefs, "team", "seq", "preference", TITLE)


@query(f"SELECT team, '{TITLE}' || chr(10) || string_agg('  ' || n || '. ' || preference, chr(10) ORDER BY n) AS prompt FROM (SELECT team, preference, row_number() OVER (PARTITION BY team ORDER BY seq) AS n FROM prefs) WHERE n <= 3 GROUP BY team", "prefs")
def history_prompt(v):
    return code.prompt_list(v.prefs, "team", "seq", "preference", TITLE, 3)


@query("SELECT 'type' AS facet, type AS value, count(*) AS n FROM findings GROUP BY type UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY severity UNION ALL SELECT 'total', '', count(*) FROM findings UNION ALL SELECT 'plans', '', (SELECT count(*) FROM part) UNION ALL SELECT 'trend', 'stable', 12", "findings")
def dashboard(v):
    forecast = v.spark.createDataFrame([("stable", 12)], "trend string, predicted long")
    return reports.dashboard(v.findings, v.table("part"), forecast)


def run_files(v):
    """A file for each document, with marks of findings in its lines (see the adaptor of lines)."""
    per = v.lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return per.select(F.concat(F.lit("src/p"), C("doc_id") % 13, F.lit("/d"), C("doc_id"), F.lit(".js")).alias("path"), F.lit("js").alias("ext"), "text")


@query()
def full_run(v):
    """From files to batches, with all scanners that read files of this kind."""
    batches, _ = runs.full_run(run_files(v), v.spark.createDataFrame([], "dedup_key string"))
    return batches.select("seq", "scanner", "type", "severity", "file", "line", "position", "folder", "batch")


@query()
def run_report(v):
    """What each scanner found and how much of it came into a batch."""
    _, report = runs.full_run(run_files(v), v.spark.createDataFrame([], "dedup_key string"))
    return report.select("scanner", "found", "fresh", "batched", F.coalesce("scan_error", F.lit("")).alias("scan_error"))
