"""Rule and weight tables.  Every table here is small and fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities with the weights, ranks and hours that the rules use.
SEVERITY_WEIGHT = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 2.0, "info": 1.0}
SEVERITY_SCORE = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SEVERITY_HOURS = {"critical": 8.0, "high": 4.0, "medium": 2.0, "low": 1.0, "info": 0.5}
SCAN_HOURS = {"critical": 4.0, "high": 2.0, "medium": 1.0, "low": 0.5}
EFFORT_DIVISOR = {"low": 1.0, "medium": 2.0, "high": 4.0}
EFFORT_HOURS = {"deprecated_api": 2.0, "todo_comment": 0.5, "code_smell": 1.5, "security": 3.0, "missing_type_hints": 0.25}
TYPE_MULTIPLIER = {"deprecated_api": 1.5, "security": 3.0, "code_smell": 1.0, "todo_comment": 0.5, "type_coverage": 0.8}
TYPE_BONUS = {"security": -1, "deprecated_api": 0, "code_smell": 1, "todo_comment": 2, "missing_type_hints": 3}
PRIORITY_LABEL = {"critical": "P1-critical", "high": "P2-high", "medium": "P3-medium", "low": "P4-low", "info": "P4-low"}
TYPE_LABEL = {"deprecated_api": "deprecation", "security": "security", "code_smell": "code-smell", "todo_comment": "todo", "type_coverage": "type-coverage"}
BOARD_PRIORITY = {"critical": 1, "high": 1, "medium": 2, "low": 3, "info": 4}
CRITICAL_PARTS = ["payment", "auth", "billing", "security", "crypto", "checkout", "token", "credential", "session"]
REGULATED_PARTS = ["pii", "credit_card", "ssn", "hipaa", "gdpr", "ferpa", "sox", "pci", "phi", "personal_data"]
SENSITIVE_GLOBS = ["**/auth/**", "**/payments/**", "**/security/**"]
CRITICAL_FILES = ["main.py", "__init__.py", "app.py", "wsgi.py", "asgi.py", "manage.py", "conftest.py"]
CRITICAL_DIRS = ["api/", "routes/", "endpoints/", "auth/", "middleware/"]

# Permissions of each role ("*" stands for all).
ROLE_PERMISSIONS = {
    "admin": ["*"],
    "security_admin": ["scan", "plan", "view_reports", "view_audit_logs", "override_security", "approve_plans", "approve_prs"],
    "team_lead": ["scan", "plan", "execute", "create_pr", "view_reports", "view_audit_logs", "approve_plans", "approve_prs"],
    "contributor": ["scan", "plan", "execute", "create_pr", "view_reports", "approve_prs"],
    "developer": ["scan", "plan", "view_reports"],
    "viewer": ["view_reports"],
}

# Security patterns (category, pattern, severity, weakness, priority).
SECURITY_RULES = [
    ("hardcoded_secrets", r"""(?i)(?:password|passwd|secret|api_key|apikey|token|auth_token|access_key|private_key)\s*=\s*["'][^"']{4,}["']""", "critical", "CWE-798", 190.0),
    ("hardcoded_secrets", r"""(?i)(?:AWS|AZURE|GCP|GITHUB|SLACK|STRIPE)[_A-Z]*(?:KEY|SECRET|TOKEN)\s*=\s*["'][^"']+["']""", "critical", "CWE-798", 195.0),
    ("weak_crypto", r"hashlib\.(?:md5|sha1)\b", "high", "CWE-328", 140.0),
    ("weak_crypto", r"from\s+Crypto\.Cipher\s+import\s+DES\b", "high", "CWE-327", 140.0),
    ("weak_crypto", r"\bnew\s+(?:MD5|SHA1)(?:Managed|CryptoServiceProvider)?\s*\(", "high", "CWE-328", 140.0),
    ("weak_crypto", r'"crypto/md5"|"crypto/sha1"', "high", "CWE-328", 140.0),
    ("weak_crypto", r"""MessageDigest\.getInstance\s*\(\s*["'](?:MD5|SHA-1)["']""", "high", "CWE-328", 140.0),
    ("sql_injection", r"""\.execute\s*\(\s*(?:f["']|["'].*%[sd]|.*\.format\s*\()""", "critical", "CWE-89", 185.0),
    ("sql_injection", r"\bSqlCommand\s*\([^)]*\+", "critical", "CWE-89", 185.0),
    ("sql_injection", r"\bdb\.(?:Query|Exec)\s*\([^)]*\+", "critical", "CWE-89", 185.0),
    ("sql_injection", r"(?:Statement|PreparedStatement).*execute(?:Query|Update)?\s*\([^)]*\+", "critical", "CWE-89", 185.0),
    ("command_injection", r"os\.system\s*\(", "high", "CWE-78", 150.0),
    ("command_injection", r"subprocess\.(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True", "high", "CWE-78", 150.0),
    ("command_injection", r"\beval\s*\(", "high", "CWE-95", 160.0),
    ("command_injection", r"\bexec\s*\(", "high", "CWE-95", 155.0),
    ("command_injection", r"\bProcess\.Start\s*\(", "high", "CWE-78", 150.0),
    ("command_injection", r"\bexec\.Command\s*\(", "high", "CWE-78", 150.0),
    ("command_injection", r"\bRuntime\.getRuntime\s*\(\s*\)\.exec\s*\(", "high", "CWE-78", 150.0),
    ("deserialization", r"pickle\.loads?\s*\(", "critical", "CWE-502", 180.0),
    ("deserialization", r"yaml\.load\s*\(", "high", "CWE-502", 160.0),
    ("path_traversal", r"open\s*\(.*(?:request|input|argv|args|params)", "medium", "CWE-22", 100.0),
]

# What an attacker could do, by category of a security rule.
EXPLOIT_SCENARIOS = {
    "hardcoded_secrets": "An attacker with repository access (or via a leaked repo) can extract credentials and gain unauthorised access to external services, databases, or cloud resources.",
    "weak_crypto": "Weak hash algorithms (MD5, SHA-1) are vulnerable to collision attacks. An attacker could forge data that produces the same hash, bypassing integrity checks or password verification.",
    "sql_injection": "An attacker can craft malicious input to modify SQL queries, allowing data exfiltration, authentication bypass, or complete database compromise.",
    "command_injection": "An attacker can inject shell commands through unsanitised input, gaining arbitrary code execution on the server with the application's privileges.",
    "deserialization": "Deserializing untrusted data (e.g. pickle, YAML) can lead to Remote Code Execution (RCE) — an attacker crafts a payload that runs arbitrary code when deserialized.",
    "path_traversal": "An attacker can use '../' sequences in file paths to read or write arbitrary files on the server, potentially exposing sensitive data or overwriting configuration.",
}

# Clauses of standards that a category of security rules touches.
COMPLIANCE = {
    "hardcoded_secrets": ["PCI DSS 6.5.3 — Insecure cryptographic storage", "SOC 2 CC6.1 — Logical access controls", "OWASP A07:2021 — Identification and Authentication Failures"],
    "weak_crypto": ["PCI DSS 6.5.3 — Insecure cryptographic storage", "GDPR Art. 32 — Appropriate security measures", "OWASP A02:2021 — Cryptographic Failures"],
    "sql_injection": ["PCI DSS 6.5.1 — Injection flaws", "OWASP A03:2021 — Injection", "GDPR Art. 32 — Appropriate security measures"],
    "command_injection": ["PCI DSS 6.5.1 — Injection flaws", "OWASP A03:2021 — Injection"],
    "deserialization": ["OWASP A08:2021 — Software and Data Integrity Failures", "PCI DSS 6.5.1 — Injection flaws"],
    "path_traversal": ["OWASP A01:2021 — Broken Access Control", "PCI DSS 6.5.8 — Improper access control"],
}

# Secrets in changed code, counted one pattern at a time.
SECRET_PATTERNS = [
    r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*['"][A-Za-z0-9_\-]{16,}['"]""",
    r"""(?i)(?:secret|password|passwd|pwd)\s*[:=]\s*['"][^'"]{8,}['"]""",
    r"""(?i)(?:token|bearer)\s*[:=]\s*['"][A-Za-z0-9_\-\.]{16,}['"]""",
    r"""(?i)(?:AWS_SECRET_ACCESS_KEY|aws_secret)\s*[:=]\s*['"][^'"]+['"]""",
    r"""(?i)(?:PRIVATE[_-]?KEY)\s*[:=]\s*['"]-----BEGIN""",
    r"ghp_[A-Za-z0-9]{36}",
    r"sk-[A-Za-z0-9]{32,}",
    r"AKIA[A-Z0-9]{16}",
]

# Masks for log text, in order (pattern, replacement).
MASKS = [
    (r"\bghp_[A-Za-z0-9]{20,}\b", "***REDACTED***"),
    (r"\bsk-[A-Za-z0-9\-_]{20,}\b", "***REDACTED***"),
    (r"\bAKIA[A-Z0-9]{16}\b", "***REDACTED***"),
    (r"(?i)(password|passwd|secret|token|api[_-]?key|authorization)\s*([:=])\s*([^,\s;]+)", "$1$2***REDACTED***"),
    (r"(?i)(Bearer\s+)([A-Za-z0-9\-._~+/]+=*)", "$1***REDACTED***"),
    (r"(?i)(InstrumentationKey|AccountKey|SharedAccessKey|Sig)=([^;\s]+)", "$1=***REDACTED***"),
]

# Signals in build logs (key, confidence, command, pattern).
LOG_SIGNALS = [
    ("ruff", 0.9, "ruff check src tests --fix", r"ruff|\bF\d{3}\b|\bE\d{3}\b|Ruff check|Ruff format"),
    ("mypy", 0.9, "mypy src", r"mypy|error: Incompatible|error: Argument|error: Return value"),
    ("pytest", 0.85, "pytest -q", r"== FAILURES ==|FAILED\s+\w|AssertionError|E\s+assert"),
    ("bandit", 0.8, "bandit -r src -f json", r"bandit|issue_severity|B\d{3}:|>> Issue:"),
    ("packaging", 0.75, "pip install -U pip setuptools wheel", r"ResolutionImpossible|No matching distribution found|Could not find a version"),
]

# Recommended least versions (package, version, severity).
RECOMMENDED = [("pydantic", "2.8.0", "medium"), ("httpx", "0.27.0", "medium"), ("pygithub", "2.3.0", "high"), ("fastmcp", "2.14.0", "medium"), ("requests", "2.32.0", "medium")]

# Deprecated names (name, severity, since, removed in, priority).
DEPRECATED = [
    ("pandas.DataFrame.append", "high", "1.4.0", "2.0.0", 150.0),
    ("pandas.DataFrame.iteritems", "medium", "1.5.0", "2.0.0", 100.0),
    ("pandas.DataFrame.swaplevel", "low", "1.5.0", "2.0.0", 50.0),
    ("numpy.float", "high", "1.20.0", "1.24.0", 130.0),
    ("numpy.int", "high", "1.20.0", "1.24.0", 130.0),
    ("numpy.bool", "high", "1.20.0", "1.24.0", 130.0),
    ("numpy.str", "high", "1.20.0", "1.24.0", 130.0),
    ("numpy.complex", "high", "1.20.0", "1.24.0", 130.0),
    ("numpy.object", "high", "1.20.0", "1.24.0", 130.0),
    ("numpy.matrix", "high", "1.15.0", "", 120.0),
    ("os.popen", "medium", "3.0", "", 90.0),
    ("os.system", "high", "3.0", "", 110.0),
    ("typing.List", "low", "3.9", "", 40.0),
    ("typing.Dict", "low", "3.9", "", 40.0),
    ("typing.Set", "low", "3.9", "", 40.0),
    ("typing.Tuple", "low", "3.9", "", 40.0),
    ("typing.Optional", "low", "3.10", "", 30.0),
    ("requests.packages.urllib3", "low", "2.16.0", "", 40.0),
    ("flask.Markup", "medium", "2.0.0", "", 80.0),
    ("flask.json.jsonify", "low", "2.2.0", "", 30.0),
    ("django.utils.encoding.smart_text", "medium", "4.0", "", 80.0),
    ("django.conf.urls.url", "high", "3.1", "4.0", 120.0),
    ("unittest.TestCase.assertEquals", "low", "3.2", "", 30.0),
    ("collections.MutableMapping", "high", "3.3", "3.10", 140.0),
    ("collections.MutableSequence", "high", "3.3", "3.10", 140.0),
]
JS_DEPRECATED = [("fs.exists", "high", 145.0), ("new Buffer", "high", 155.0), ("util.print", "medium", 120.0)]


def pick(column: Column | str, table: dict, default) -> Column:
    """The value of ``table`` for a column, as one CASE."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def pick_sql(column: str, table: dict, default) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    return "CASE " + " ".join(f"WHEN {column} = {show(k)} THEN {show(v)}" for k, v in table.items()) + f" ELSE {show(default)} END"


def text_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table, small enough to be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def values_sql(rows: list[tuple], names: str) -> str:
    show = lambda v: text_sql(v) if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows) + f") AS t({names})"


def glob_to_regex(glob: str) -> str:
    """A shell pattern as a regular expression that must match the whole text; ``*`` crosses slashes."""
    out = ["(?s)^"]
    for c in glob:
        out.append(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c)
    return "".join(out) + "$"


def any_glob(column: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | column.rlike(glob_to_regex(g))
    return out


def contains_count(column: Column, parts: list[str]) -> Column:
    """How many of the parts occur in a lower-cased column."""
    low = F.lower(column)
    out = F.lit(0)
    for p in parts:
        out = out + low.contains(p).cast("int")
    return out


def contains_count_sql(column: str, parts: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({column}), '{p}')::INT" for p in parts) + ")"


def version(column: Column) -> Column:
    """All runs of digits as numbers; (0) without any."""
    found = F.transform(F.regexp_extract_all(column, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0)))


def version_sql(column: str) -> str:
    found = rf"list_transform(regexp_extract_all({column}, '(\d+)', 1), lambda x: x::INT)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [0] END"
