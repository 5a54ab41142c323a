"""Queries of the text detectors and of rule, theta and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import detect, matching, ranking
from .catalogue import query

C = F.col
T = dims.text_sql
TODO = T(detect.todo_pattern())


@query("SELECT doc_id, line_no, path, text FROM lines", "lines")
def line_explode(v):
    return v.lines


SEV = "CASE tag WHEN 'FIXME' THEN 'high' WHEN 'HACK' THEN 'high' ELSE 'medium' END"
TODOS = f"todo AS (SELECT doc_id, line_no, path, upper(regexp_extract(text, {TODO}, 1)) AS tag, trim(regexp_extract(text, {TODO}, 2)) AS message FROM lines WHERE regexp_matches(text, {TODO}))"


@query(f"WITH {TODOS} SELECT doc_id, line_no, tag, message, {SEV} AS severity FROM todo", "lines")
def todo_scan(v):
    return detect.todos(v.lines).select("doc_id", "line_no", "tag", "message", "severity")


BLAME = "blame AS (SELECT DISTINCT path, line_no, 'author' || (line_no % 5) AS author, DATE '2024-01-01' - (line_no * 17 % 400)::INT AS authored FROM lines WHERE line_no % 2 = 0)"


@query(
    f"""WITH {TODOS}, {BLAME}, b AS (SELECT todo.*, author, date_diff('day', authored, DATE '2024-03-01') AS age FROM todo LEFT JOIN blame USING (path, line_no)),
s AS (SELECT *, CASE WHEN age > 180 THEN 'critical' WHEN age > 90 THEN 'high' WHEN age > 45 AND {SEV} IN ('low', 'info') THEN 'medium' ELSE {SEV} END AS severity FROM b)
SELECT doc_id, line_no, author, age::INT AS age_days, severity, least(200, 10 * {dims.pick_sql('severity', dims.SEVERITY_WEIGHT, 4.0)} + coalesce(least(50, 20.0::DOUBLE * age / 90), 0))::DOUBLE AS priority FROM s""",
    "lines",
)
def todo_priority(v):
    n = C("line_no")
    blame = v.lines.filter(n % 2 == 0).select("path", "line_no", F.concat(F.lit("author"), n % 5).alias("author"), F.date_sub(F.lit("2024-01-01").cast("date"), (n * 17 % 400).cast("int")).alias("authored")).distinct()
    aged = detect.aged(detect.blamed(detect.todos(v.lines), blame, F.lit("2024-03-01").cast("date")))
    return aged.select("doc_id", "line_no", "author", "age_days", "severity", "priority")


RULE_ROWS = [(i, c, s, w, p) for i, (c, _, s, w, p) in enumerate(dims.SECURITY_RULES)]


@query(" UNION ALL ".join(f"SELECT doc_id, line_no, {i}::INT AS rule, '{c}' AS category, '{s}' AS severity, '{w}' AS cwe, {p!r}::DOUBLE AS priority FROM lines WHERE regexp_matches(text, {T(x)})" for i, (c, x, s, w, p) in enumerate(dims.SECURITY_RULES)), "lines")
def security_pattern_scan(v):
    return detect.rule_hits(v.lines).select("doc_id", "line_no", "rule", "category", "severity", "cwe", "priority")


@query(
    "WITH hits AS (" + " UNION ALL ".join(f"SELECT doc_id, line_no, {i}::INT AS rule, '{c}' AS category FROM lines WHERE regexp_matches(text, {T(x)})" for i, (c, x, *_) in enumerate(dims.SECURITY_RULES))
    + f"), facts AS (SELECT * FROM (VALUES {', '.join('(' + T(c) + ', ' + T(t) + ', ' + T('; '.join(dims.COMPLIANCE[c])) + ')' for c, t in dims.EXPLOIT_SCENARIOS.items())}) AS t(category, exploit_scenario, compliance)) SELECT doc_id, line_no, rule, category, exploit_scenario, compliance FROM hits JOIN facts USING (category)",
    "lines",
)
def security_impact(v):
    hits = detect.with_impact(detect.rule_hits(v.lines))
    return hits.select("doc_id", "line_no", "rule", "category", "exploit_scenario", F.array_join("compliance", "; ").alias("compliance"))


@query(" UNION ALL ".join(f"SELECT doc_id, line_no, {i}::INT AS rule FROM lines WHERE regexp_matches(text, {T(x)})" for i, (c, x, *_) in enumerate(dims.SECURITY_RULES) if c in ("weak_crypto", "sql_injection")), "lines")
def security_categories(v):
    return detect.rule_hits(v.lines, categories=["weak_crypto", "sql_injection"]).select("doc_id", "line_no", "rule")


@query(" UNION ALL ".join(f"SELECT doc_id, line_no, {i}::INT AS pattern, len(regexp_extract_all(text, {T(p)}))::INT AS n FROM lines WHERE regexp_matches(text, {T(p)})" for i, p in enumerate(dims.SECRET_PATTERNS)), "lines")
def secret_counts(v):
    return detect.secret_counts(v.lines).select("doc_id", "line_no", "pattern", "n")


def masked_sql(c: str) -> str:
    for p, to in dims.MASKS:
        c = f"regexp_replace({c}, {T(p)}, {T(to.replace('$', chr(92)))}, 'g')"
    return c


@query(f"SELECT doc_id, line_no, {masked_sql('text')} AS masked FROM lines WHERE {masked_sql('text')} <> text", "lines")
def mask_secrets(v):
    return v.lines.withColumn("masked", detect.masked(C("text"))).filter("masked <> text").select("doc_id", "line_no", "masked")


@query(" UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS key, {c!r}::DOUBLE AS confidence, '{cmd}' AS command FROM lines WHERE regexp_matches(text, {T('(?im)' + p)})" for k, c, cmd, p in dims.LOG_SIGNALS), "lines")
def ci_signals(v):
    return detect.log_signals(v.lines).select("doc_id", "line_no", "key", "confidence", "command")


F401, MYPY = (T(c[2]) for c in detect.CANDIDATES)


def candidate_sql(number: int, pattern: str) -> str:
    name, marker, _, parsed, marked = detect.CANDIDATES[number]
    return f"""SELECT path, regexp_extract(text, {pattern}, 1) AS target_file, regexp_extract(text, {pattern}, 2)::INT AS target_line, max_by(regexp_extract(text, {pattern}, 3), (doc_id, line_no, text)) AS symbol, {parsed}::DOUBLE AS confidence, '{name}' AS candidate
  FROM lines WHERE regexp_matches(text, {pattern}) GROUP BY ALL
UNION ALL SELECT path, 'unknown', 0, '', {marked}::DOUBLE, '{name}' FROM lines WHERE contains(text, '{marker}') GROUP BY path HAVING NOT bool_or(regexp_matches(text, {pattern}))"""


@query(candidate_sql(0, F401) + " UNION ALL " + candidate_sql(1, MYPY), "lines")
def patch_candidates(v):
    return detect.lint_candidates(v.lines, "path")


SIGNALS = " UNION ALL ".join(f"SELECT path, {i} AS ord, '{cmd}' AS command FROM lines WHERE regexp_matches(text, {T('(?im)' + p)})" for i, (k, c, cmd, p) in enumerate(dims.LOG_SIGNALS))


@query(
    f"""WITH s AS (SELECT DISTINCT path, ord, command FROM ({SIGNALS})), f AS (SELECT path, command, min(ord) AS ord FROM s GROUP BY ALL), c AS (SELECT path, array_to_string(list(command ORDER BY ord), ' && ') AS commands FROM f GROUP BY path), n AS (SELECT path, count(*)::INT AS n_signals FROM s GROUP BY path)
SELECT path, CASE WHEN n_signals IS NULL THEN 'no-signals-detected' ELSE 'signals-detected' END AS status, coalesce(n_signals, 0)::INT AS n_signals, coalesce(commands, '{" && ".join(detect.DEFAULT_COMMANDS)}') AS commands FROM (SELECT DISTINCT path FROM lines) LEFT JOIN n USING (path) LEFT JOIN c USING (path)""",
    "lines",
)
def healing_plan(v):
    return detect.healing_plans(v.lines, "path").select("path", "status", "n_signals", F.array_join("commands", " && ").alias("commands"))


NAMES = T(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)")
CALLS = f"""rules AS (SELECT * FROM {dims.values_sql(dims.DEPRECATED, 'name, severity, since, removed, priority')}), names AS (SELECT DISTINCT doc_id, line_no, path, unnest(regexp_extract_all(text, {NAMES}, 1)) AS name FROM lines), hits AS (SELECT * FROM names JOIN rules USING (name))"""


@query(f"WITH {CALLS} SELECT doc_id, line_no, name, severity, priority FROM hits", "lines")
def deprecated_calls(v):
    return detect.named_calls(v.lines).select("doc_id", "line_no", "name", "severity", "priority")


@query(
    f"""WITH {CALLS}, u AS (SELECT name, count(*) AS uses, count(DISTINCT path) AS files FROM hits GROUP BY name)
SELECT doc_id, line_no, name, uses, files, least(200, priority * CASE WHEN uses >= 10 THEN 1.3 WHEN uses >= 5 THEN 1.15 ELSE 1.0 END::DOUBLE) AS boosted FROM hits JOIN u USING (name)""",
    "lines",
)
def usage_frequency_boost(v):
    return detect.usage_boost(detect.named_calls(v.lines)).select("doc_id", "line_no", "name", "uses", "files", "boosted")


@query(" UNION ALL ".join(f"SELECT path, '{n}' AS name, '{s}' AS severity, {p!r}::DOUBLE AS priority, min(line_no) AS line_no FROM lines WHERE contains(text, '{n}(') GROUP BY path" for n, s, p in dims.JS_DEPRECATED), "lines")
def script_calls(v):
    return detect.script_calls(v.lines)


INSTALLED = [("1.5.0", "2.0.0"), ("2.1", "2.0.0"), ("1.23.4", "1.24.0"), ("1.22", "1.24.0"), ("3", ""), ("2.0", "2.0.0")]
V = dims.version_sql


@query(
    f"""WITH t AS (SELECT * FROM {dims.values_sql(INSTALLED, 'installed, removed')}), p AS (SELECT *, {V('installed')} AS a, {V('removed')} AS b FROM t)
SELECT installed, removed, CASE WHEN removed = '' THEN 1.0 WHEN a >= b THEN 2.0 WHEN a[1] = b[1] AND coalesce(b[2], 0) - coalesce(a[2], 0) <= 1 THEN 1.5 ELSE 1.0 END::DOUBLE AS urgency FROM p"""
)
def removal_urgency(v):
    return detect.removal_urgency(v.spark.createDataFrame(INSTALLED, "installed string, removed string"))


@query(
    f"""WITH r AS (SELECT * FROM {dims.values_sql(dims.RECOMMENDED, 'package, least_v, rule_severity')}), j AS (SELECT p.seq, r.*, op, {V('ver')} < {V('least_v')} AS older FROM packages p JOIN r ON r.package = replace(lower(trim(p.package)), '_', '-'))
SELECT seq, package, CASE WHEN op = '==' THEN rule_severity WHEN op = '' THEN 'low' ELSE 'medium' END AS severity, CASE WHEN op = '==' THEN 1.5 WHEN op = '' THEN 1.0 ELSE 1.2 END::DOUBLE AS urgency FROM j WHERE op = '==' AND older OR op = '' OR op IN ('<', '<=') AND older""",
    "packages",
)
def dependency_eval(v):
    return detect.dependency_check(v.packages).select("seq", "package", "severity", "urgency")


@query(f"SELECT seq, ver, {V('ver')} < {V(T('2.8'))} AS older, array_to_string({V('ver')}, '.') AS parsed FROM packages", "packages")
def version_compare(v):
    return v.packages.select("seq", "ver", (dims.version(C("ver")) < dims.version(F.lit("2.8"))).alias("older"), F.array_join(dims.version(C("ver")).cast("array<string>"), ".").alias("parsed"))


@query(f"SELECT seq, {V(T('3.1'))}[1] > {V('ver')}[1] AS major_jump FROM packages", "packages")
def major_version_jump(v):
    return detect.major_jump(v.packages.withColumn("latest", F.lit("3.1"))).select("seq", "major_jump")


LAYERS = {"p1": "ui", "p2": "ui", "p3": "core", "p4": "core", "p5": "data", "p6": "data"}
BAD = [("core", "ui"), ("data", "ui"), ("data", "core")]


@query(
    f"""WITH l AS (SELECT * FROM {dims.values_sql(list(LAYERS.items()), 'package, layer')}), f AS (SELECT * FROM {dims.values_sql(BAD, 'from_layer, to_layer')}),
i AS (SELECT DISTINCT path, 'app.p' || (doc_id % 8) || '.p' || (line_no % 8) AS imported FROM lines),
s AS (SELECT i.*, layer AS from_layer FROM i JOIN l ON l.package = CASE WHEN starts_with(path, 'src/') THEN string_split(path, '/')[2] ELSE string_split(path, '/')[1] END),
p AS (SELECT s.*, unnest(string_split(imported, '.')) AS part, unnest(range(10)[:len(string_split(imported, '.'))]) AS pos FROM s), h AS (SELECT path, imported, from_layer, min_by(layer, pos) AS to_layer FROM p JOIN l ON l.package = part GROUP BY ALL)
SELECT * FROM h JOIN f USING (from_layer, to_layer)""",
    "lines",
)
def layer_violations(v):
    imports = v.lines.select("path", F.concat(F.lit("app.p"), C("doc_id") % 8, F.lit(".p"), C("line_no") % 8).alias("imported")).distinct()
    return detect.layer_violations(imports, LAYERS, BAD)


GLOBS = ["**/p1/**", "src/p2/*", "*m13.py", "m?.py"]


@query("SELECT DISTINCT path FROM lines WHERE NOT (" + " OR ".join(f"regexp_matches(path, '{dims.glob_to_regex(g)}') OR regexp_matches('/' || path, '{dims.glob_to_regex(g)}')" for g in GLOBS) + ")", "lines")
def excluded_paths(v):
    return detect.excluded(v.lines.select("path").distinct(), GLOBS)


IGNORES = [("build/",), ("# note",), ("!keep",), ("",), ("docs/api/",), ("*.log",), ("  tmp  ",)]


@query(
    f"""WITH t AS (SELECT regexp_replace(trim(text), '/$', '') AS name, trim(text) AS t FROM {dims.values_sql([(x[0], 0) for x in IGNORES], 'text, z')} WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#') AND NOT starts_with(trim(text), '!'))
SELECT name, unnest(CASE WHEN contains(name, '/') THEN [name, name || '/**'] ELSE ['**/' || name, '**/' || name || '/**'] END) AS glob FROM t"""
)
def ignore_globs(v):
    return detect.gitignore_globs(v.spark.createDataFrame(IGNORES, "text string")).select("name", "glob")


REQS = [("requests==2.31.0",), ("# comment",), ("",), ("uvicorn[standard] >=0.20 ; python_version > '3'",), ("??bad",), ("numpy",), ("a.b-c_d<3,>=1",)]
RP = T(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)")


@query(f"SELECT regexp_extract(text, {RP}, 1) AS package, trim(regexp_extract(text, {RP}, 2)) AS spec FROM {dims.values_sql([(x[0], 0) for x in REQS], 'text, z')} WHERE NOT regexp_matches(trim(text), '^(#|$)') AND regexp_matches(text, {RP})")
def requirements(v):
    return detect.requirement(v.spark.createDataFrame(REQS, "text string")).select("package", "spec")


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS n_lines, least(200, 50 + 0.1::DOUBLE * (length(text) - length(replace(text, chr(10), '')) + 1 - 20))::DOUBLE AS priority FROM documents WHERE length(text) - length(replace(text, chr(10), '')) + 1 > 20")
def long_files(v):
    return detect.long_files(v.table("documents").select("doc_id", "text"), 20).select("doc_id", "n_lines", "priority")


@query(
    """WITH d AS (SELECT doc_id, 1 + doc_id % 12 AS line, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, greatest(line - 16, 0) + 1 AS first_line, len(ls[greatest(line - 16, 0) + 1 : least(len(ls), line + 15)])::INT AS n_window, len(list_filter(ls, lambda x: regexp_matches(trim(x), '^(import|from) ')))::INT AS n_imports FROM d"""
)
def code_windows(v):
    rows = v.table("documents").select("doc_id", "text", (C("doc_id") % 12 + 1).alias("line"))
    return detect.code_window(rows).select("doc_id", "first_line", F.size("window_lines").alias("n_window"), F.size("imports").alias("n_imports"))


VIOLATIONS = "cur AS (SELECT 'f' || (o_custkey % 40) AS file, (o_orderkey % 60)::INT AS line, 'E' || (o_orderkey % 7) AS code, 'tool' || (o_custkey % 2) AS tool, o_orderkey AS seq FROM orders)"


def violations(v):
    k, c = C("o_orderkey"), C("o_custkey")
    return v.table("orders").select(F.concat(F.lit("f"), c % 40).alias("file"), (k % 60).cast("int").alias("line"), F.concat(F.lit("E"), k % 7).alias("code"), F.concat(F.lit("tool"), c % 2).alias("tool"), k.alias("seq"))


@query(f"WITH {VIOLATIONS} SELECT seq, file, line, code, tool FROM cur WHERE seq % 2 = 0 AND (file, line, code, tool) NOT IN (SELECT (file, line, code, tool) FROM cur WHERE seq % 2 = 1)")
def new_violations(v):
    all_ = violations(v)
    return detect.new_violations(all_.filter("seq % 2 = 0"), all_.filter("seq % 2 = 1")).select("seq", "file", "line", "code", "tool")


@query(
    """WITH d AS (SELECT DISTINCT 'f' || (o_custkey % 40) AS file, CASE WHEN o_orderkey % 5 = 0 THEN '__s' ELSE '_s' END || (o_orderkey % 90) AS name FROM orders), r AS (SELECT DISTINCT 'f' || (o_custkey % 40) AS file, '_s' || (o_orderkey % 77) AS name FROM orders WHERE o_orderkey % 2 = 0)
SELECT file, name FROM d WHERE starts_with(name, '_') AND NOT starts_with(name, '__') AND (file, name) NOT IN (SELECT (file, name) FROM r)"""
)
def dead_symbols(v):
    k, c = C("o_orderkey"), C("o_custkey")
    o = v.table("orders")
    defs = o.select(F.concat(F.lit("f"), c % 40).alias("file"), F.concat(F.when(k % 5 == 0, "__s").otherwise("_s"), k % 90).alias("name")).distinct()
    return detect.dead_symbols(defs, o.filter(k % 2 == 0).select(F.concat(F.lit("f"), c % 40).alias("file"), F.concat(F.lit("_s"), k % 77).alias("name")))


@query(
    """WITH p AS (SELECT 'f' || (o_custkey % 200) AS file, count(*) AS total, sum((o_orderkey % 3 <> 0)::INT)::BIGINT AS typed FROM orders GROUP BY 1), q AS (SELECT *, 100.0::DOUBLE * typed / total AS pct FROM p)
SELECT file, total, typed, round(pct, 6) AS pct, CASE WHEN pct < 40 THEN 'medium' ELSE 'low' END AS severity, round(25 + 0.3::DOUBLE * (80 - pct), 6) AS priority FROM q WHERE pct < 80"""
)
def type_coverage(v):
    rows = v.table("orders").select(F.concat(F.lit("f"), C("o_custkey") % 200).alias("file"), (C("o_orderkey") % 3 != 0).alias("typed"))
    return detect.typed_share(rows).select("file", "total", "typed", F.round("pct", 6).alias("pct"), "severity", F.round("priority", 6).alias("priority"))


@query("SELECT path, count(*) AS n, min(line_no) AS first_line FROM lines WHERE contains(text, 'the ') GROUP BY path ORDER BY n DESC, path LIMIT 50", "lines")
def symbol_references(v):
    return ranking.top_k(v.lines.filter(C("text").contains("the ")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")), 50, F.desc("n"), F.asc("path"))


@query("SELECT path, line_no, doc_id, trim(text) AS text, count(*) OVER () AS total FROM lines WHERE contains(text, 'the ') ORDER BY path, line_no, doc_id LIMIT 50", "lines")
def reference_lines(v):
    return ranking.reference_lines(v.lines, "the ").select("path", "line_no", "doc_id", "text", "total")


@query(
    """WITH m AS (SELECT DISTINCT 'm' || doc_id AS stem FROM documents), t AS (SELECT DISTINCT 'test_m' || (doc_id * 7 % 1009) AS test FROM documents) SELECT stem, test FROM m JOIN t ON test = 'test_' || stem OR contains(test, stem)"""
)
def test_discovery(v):
    d = v.table("documents")
    stems, tests = d.select(F.concat(F.lit("m"), C("doc_id")).alias("needle")), d.select(F.concat(F.lit("test_m"), C("doc_id") * 7 % 1009).alias("text"))
    return matching.containing(tests, stems).select(C("needle").alias("stem"), C("text").alias("test"))
