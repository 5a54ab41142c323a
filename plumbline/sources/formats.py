"""Readers of structured text: tool reports, replies, bodies, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims

C = F.col


def issue_report(df: DataFrame) -> DataFrame:
    """Issues of a security scanner's JSON report, one row each (SRC-16)."""
    shape = "results array<struct<filename:string,line_number:int,issue_severity:string,test_id:string,issue_text:string>>"
    rows = df.select("*", F.explode(F.from_json("report", shape)["results"]).alias("r"))
    level = dims.pick(C("r.issue_severity"), {"LOW": "medium", "MEDIUM": "high", "HIGH": "critical"}, "medium")
    return rows.withColumn("file", C("r.filename")).withColumn("line", C("r.line_number")).withColumn("severity", level).withColumn("priority", dims.pick("severity", {"medium": 80.0, "high": 140.0, "critical": 180.0}, 80.0))


def lint_report(df: DataFrame) -> DataFrame:
    """Violations of a linter's JSON report (SRC-17)."""
    shape = "array<struct<filename:string,code:string,message:string,location:struct<row:int>>>"
    return df.select("*", F.explode(F.from_json("report", shape)).alias("r")).select(*df.columns, C("r.filename").alias("file"), C("r.location.row").alias("line"), C("r.code").alias("code"), C("r.message").alias("message"))


def colon_report(df: DataFrame) -> DataFrame:
    """Lines of ``file:line: severity: message`` (SRC-18)."""
    parts = F.split("text", ":", 4)
    rows = df.withColumn("parts", parts).filter((F.size("parts") == 4) & F.trim(F.get("parts", F.lit(1))).rlike("^[0-9]+$"))
    return rows.select(*df.columns, F.get("parts", F.lit(0)).alias("file"), F.get("parts", F.lit(1)).cast("int").alias("line"), F.trim(F.get("parts", F.lit(2))).alias("severity"), F.trim(F.get("parts", F.lit(3))).alias("message"))


def json_number(column: str, path: str, default: float) -> Column:
    """A number out of a JSON text, or a default (SRC-20)."""
    return F.coalesce(F.try_to_number(F.get_json_object(column, path), F.lit("999999999")).cast("double"), F.get_json_object(column, path).try_cast("double"), F.lit(default))


def audit_report(df: DataFrame) -> DataFrame:
    """Weaknesses of dependencies: two nested explodes (SRC-21)."""
    shape = "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,fix_versions:array<string>>>>>"
    deps = df.select(F.explode(F.from_json("report", shape)["dependencies"]).alias("d"))
    return deps.select(C("d.name").alias("name"), C("d.version").alias("version"), F.explode("d.vulns").alias("v")).select("name", "version", C("v.id").alias("id"), F.when(F.size("v.fix_versions") > 0, "HIGH").otherwise("MEDIUM").alias("severity"))


def junit_counts(df: DataFrame) -> DataFrame:
    """Test counts of an XML report: failed, then in error, skipped, passed (SRC-19)."""
    n = lambda p: F.xpath_int("report", F.lit(f"count({p})"))
    failed, error, skipped = "//testcase[failure]", "//testcase[error and not(failure)]", "//testcase[skipped and not(failure) and not(error)]"
    return df.select("*", n("//testcase").alias("run"), n(failed).alias("failed"), n(error).alias("errors"), n(skipped).alias("skipped")).withColumn("passed", C("run") - C("failed") - C("errors") - C("skipped"))


def plan_reply(df: DataFrame) -> DataFrame:
    """The outermost JSON object of a reply, with defaults and held ranges (TXT-2)."""
    shape = "summary string, confidence_score int, risk_level string, changes array<struct<file_path:string,change_type:string>>"
    rows = df.withColumn("p", F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), shape))
    risk = F.when(C("p.risk_level").isin("low", "medium", "high"), C("p.risk_level")).otherwise("medium")
    return rows.withColumn("summary", F.coalesce("p.summary", F.lit(""))).withColumn("confidence", F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("p.confidence_score", F.lit(5))))).withColumn("risk", risk).withColumn("changes", F.coalesce("p.changes", F.from_json(F.lit("[]"), "array<struct<file_path:string,change_type:string>>"))).drop("p")


def reply_list(df: DataFrame, shape: str) -> DataFrame:
    """The outermost JSON array of a reply, one row for each item, with its place (TXT-3, TXT-4)."""
    return df.select("*", F.posexplode(F.from_json(F.regexp_extract("reply", r"(?s)(\[.*\])", 1), f"array<{shape}>")).alias("pos", "item"))


def pr_body(df: DataFrame) -> DataFrame:
    """Finding, type and confidence of a pull request's text (TXT-6)."""
    id_ = F.regexp_extract("body", r"Finding ID:\s*(\S+)", 1)
    sure = F.regexp_extract("body", r"Confidence:\s*(\d+)/10", 1)
    return df.withColumn("finding_id", F.when(id_ != "", id_).otherwise(F.concat(F.lit("pr-"), C("pr")))).withColumn("finding_type", F.regexp_extract("body", r"Type:\s*(\S+)", 1)).withColumn("confidence", F.nullif(sure, F.lit("")).cast("int"))


def first_role(df: DataFrame) -> DataFrame:
    """The first claim that names a role, else viewer (TXT-21)."""
    known = F.transform("claims", lambda c: F.regexp_replace(F.lower(c), "[- ]", "_"))
    roles = F.filter(known, lambda c: c.isin(*dims.ROLE_PERMISSIONS))
    return df.withColumn("role", F.coalesce(F.get(roles, F.lit(0)), F.lit("viewer")))


# Marker files and extensions.
MANAGERS = {"pyproject.toml": "pip", "requirements.txt": "pip", "poetry.lock": "poetry", "uv.lock": "uv", "package.json": "npm", "yarn.lock": "yarn", "go.mod": "go", "pom.xml": "maven"}
CI = [(r"^\.github/workflows/", "github-actions"), (r"^\.gitlab-ci\.yml$", "gitlab"), (r"^azure-pipelines\.yml$", "azure"), (r"^Jenkinsfile$", "jenkins")]
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "cs": "csharp"}
SENSITIVE = ["auth", "payments", "security", "billing", "secrets"]


def project_facts(files: DataFrame) -> DataFrame:
    """Package managers, build services, languages and sensitive folders of each repository's file list (TXT-31, TXT-33, TXT-35, AGG-33)."""
    folders = F.slice(F.split("path", "/"), 1, 2)
    inner = F.filter(F.when(F.size(F.split("path", "/")) > 1, F.array_except(F.array_intersect(folders, F.array(*map(F.lit, SENSITIVE))), F.slice(F.split("path", "/"), -1, 1))).otherwise(F.array().cast("array<string>")), lambda x: x.isNotNull())
    service = None
    for pattern, name in CI:
        service = F.when(C("path").rlike(pattern), name) if service is None else service.when(C("path").rlike(pattern), name)
    facts = F.concat(
        F.array_compact(
            F.array(
                F.concat(F.lit("manager:"), dims.pick("path", MANAGERS, None)),
                F.concat(F.lit("ci:"), service),
                F.concat(F.lit("language:"), dims.pick(F.regexp_extract("path", r"\.(\w+)$", 1), LANGUAGES, None)),
            )
        ),
        F.transform(inner, lambda x: F.concat(F.lit("sensitive:**/"), x, F.lit("/**"))),
    )
    return files.select("repo", F.explode(facts).alias("fact"))


#: Kind, name, file, and the text that must stand in it (none: the file's being there is enough).
TOOLS = [
    ("test", "pytest", "conftest.py", None),
    ("test", "pytest", "tests/conftest.py", None),
    ("test", "pytest", "pyproject.toml", "pytest"),
    ("test", "unittest", "pyproject.toml", "unittest"),
    ("test", "jest", "jest.config.js", None),
    ("test", "jest", "jest.config.ts", None),
    ("test", "mocha", "package.json", '"mocha"'),
    ("test", "jest", "package.json", '"jest"'),
    ("linter", "ruff", "ruff.toml", None),
    ("linter", "ruff", "pyproject.toml", "[tool.ruff]"),
    ("linter", "mypy", "mypy.ini", None),
    ("linter", "mypy", ".mypy.ini", None),
    ("linter", "mypy", "pyproject.toml", "[tool.mypy]"),
    ("linter", "eslint", ".eslintrc.js", None),
    ("linter", "eslint", ".eslintrc.json", None),
    ("linter", "prettier", ".prettierrc", None),
    ("linter", "prettier", ".prettierrc.json", None),
    ("linter", "flake8", ".flake8", None),
    ("linter", "flake8", "pyproject.toml", "[flake8]"),
    ("linter", "pylint", "setup.cfg", "[pylint"),
    ("framework", "django", "manage.py", None),
    ("framework", "django", "pyproject.toml", "django"),
    ("framework", "flask", "pyproject.toml", "flask"),
    ("framework", "fastapi", "pyproject.toml", "fastapi"),
    ("framework", "pytest", "conftest.py", None),
    ("framework", "pytest", "pyproject.toml", "pytest"),
]


def project_tools(files: DataFrame) -> DataFrame:
    """Test frameworks, linters and frameworks of each repository (repo, path, text), each once (TXT-32, TXT-34, TXT-36)."""
    table = F.broadcast(files.sparkSession.createDataFrame(TOOLS, "kind string, name string, marker_file string, marker string"))
    found = files.join(table, (C("path") == C("marker_file")) & (C("marker").isNull() | F.contains("text", "marker"))).select("repo", "kind", "name")
    go = files.groupBy("repo").agg((F.max(C("path") == "go.mod") & F.max(F.endswith("path", F.lit("_test.go")))).alias("both")).filter("both")
    return found.unionByName(go.select("repo", F.lit("test").alias("kind"), F.lit("go-test").alias("name"))).distinct()


def typed_project(files: DataFrame, n: int = 10) -> DataFrame:
    """Whether one of a repository's first ``n`` Python files, by path, shows type hints (TXT-37)."""
    hints = C("text").contains("-> ") | C("text").contains(": str") | C("text").contains(": int")
    rows = files.filter(F.endswith("path", F.lit(".py"))).withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter(C("n") <= n)
    return rows.groupBy("repo").agg(F.max(hints).alias("typed"))


def language_counts(files: DataFrame, k: int = 10) -> DataFrame:
    """Files of each language of a repository, the ``k`` most frequent (AGG-33)."""
    rows = files.withColumn("language", dims.pick(F.regexp_extract(F.lower("path"), r"\.(\w+)$", 1), LANGUAGES, None)).filter("language is not null")
    n = rows.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "language"))).filter(C("rank") <= k).drop("rank")


def occurrences(df: DataFrame, needle: str) -> DataFrame:
    """How often a text holds a string; only one place can be replaced safely (TXT-24)."""
    n = ((F.length("text") - F.length(F.replace(C("text"), F.lit(needle), F.lit("")))) / len(needle)).cast("int")
    return df.withColumn("n", n).withColumn("replaceable", C("n") == 1)
