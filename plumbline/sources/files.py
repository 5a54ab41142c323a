"""Source trees as tables, and one pass over their syntax.

Python code is parsed once for each file, into tagged fact rows; detectors are SQL over these facts.
"""

from __future__ import annotations

import ast
import io
import json
import math
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from . import trees

C = F.col
FACTS = "path string, kind string, name string, line int, end_line int, parameters int, depth int, complexity int, cognitive int, typed boolean, entry boolean, owner string, place int, value double, detail string"


def source_files(spark: SparkSession, root: str, extensions: list[str], excludes: list[str] | None = None) -> DataFrame:
    """path, ext and text of the files under a root, without those that a pattern excludes (SRC-1, SRC-2).

    A file is one row, however many extensions match it.  Rows are in no order: sort paths, not texts, where one is wanted.
    """
    return trees.read_tree(spark, root, extensions, excludes)


def monthly_ledger(spark: SparkSession, folder: str, schema: str, period: str | None = None) -> DataFrame:
    """Rows of an append-only ledger in folders ``period=yyyy-MM``; malformed lines are skipped (SRC-14)."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("basePath", folder).json(folder)
    return rows.filter(C("period") == period) if period else rows


def snapshots(spark: SparkSession, folder: str, repo_hash: str, schema: str) -> DataFrame:
    """Snapshot documents of one repository, in file order (SRC-15)."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).withColumn("file", F.col("_metadata.file_name"))
    return rows.filter(F.startswith("file", F.lit(repo_hash))).orderBy("file")


def toml_dependencies(files: DataFrame) -> DataFrame:
    """Packages of project files and lock files (SRC-12, SRC-13)."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import tomllib

        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    data = tomllib.loads(text)
                except tomllib.TOMLDecodeError:
                    continue
                for d in data.get("project", {}).get("dependencies", []):
                    if m := re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)", d):
                        out.append((path, m[1], m[2].strip()))
                out += [(path, p["name"], f"=={p['version']}") for p in data.get("package", []) if isinstance(p, dict) and "name" in p and "version" in p]
            yield pd.DataFrame(out, columns=["path", "package", "spec"])

    return files.select("path", "text").mapInPandas(go, "path string, package string, spec string")


# Names of route decorators and of base classes of views.
ROUTES = {"route", "get", "post", "put", "patch", "delete"}
VIEWS = {"View", "APIView", "GenericAPIView", "ModelViewSet", "ViewSet"}


def route_kind(mark: ast.expr) -> str | None:
    """Framework of a route decorator: that of ``router.get(..)`` is fastapi, any other's flask (DET-43)."""
    target = mark.func if isinstance(mark, ast.Call) else mark
    if not isinstance(target, ast.Attribute) or target.attr not in ROUTES:
        return None
    called_on = target.value.id if isinstance(mark, ast.Call) and isinstance(target.value, ast.Name) else ""
    return "fastapi" if called_on == "router" else "flask"


def entry_point(tree: ast.Module) -> tuple[str, str] | None:
    """Kind and detail of a module's first way in, by level of the tree; a main guard comes last (DET-42)."""
    guard = None
    for node in ast.walk(tree):
        match node:
            case ast.FunctionDef(decorator_list=marks) if kinds := [k for k in map(route_kind, marks) if k]:
                return kinds[0], f"{node.name}()"
            case ast.FunctionDef(name="handler") if {"event", "context"} <= {a.arg for a in node.args.args}:
                return "lambda", "handler(event, context)"
            case ast.ClassDef(bases=bases) if any(getattr(b, "id", getattr(b, "attr", "")) in VIEWS for b in bases):
                return "django", f"class {node.name}"
            case ast.If(test=ast.Compare(left=ast.Name(id="__name__"))):
                guard = "main", 'if __name__ == "__main__"'
    return guard


def halstead_volume(tree: ast.Module) -> float:
    """Length times log2 of the vocabulary, over arithmetic, logic and comparisons; operands are told apart by function."""
    operators, operands, length = set(), set(), 0

    def look(node: ast.AST, where: str) -> None:
        nonlocal length
        match node:
            case ast.BinOp(left=a, op=op, right=b) | ast.AugAssign(target=a, op=op, value=b):
                signs, sides = [op], [a, b]
            case ast.UnaryOp(op=op, operand=a):
                signs, sides = [op], [a]
            case ast.BoolOp(op=op, values=sides):
                signs = [op]
            case ast.Compare(left=a, ops=signs, comparators=rest):
                sides = [a, *rest]
            case _:
                signs, sides = [], []
        length += len(signs) + len(sides)
        operators.update(type(s).__name__ for s in signs)
        operands.update((where, getattr(x, "id", getattr(x, "attr", repr(x.value) if isinstance(x, ast.Constant) else id(x)))) for x in sides)
        for child in ast.iter_child_nodes(node):
            look(child, node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else where)

    look(tree, "")
    words = len(operators) + len(operands)
    return length * math.log2(words) if words else 0.0


def maintainability(tree: ast.Module, text: str, branches: int) -> float:
    """Maintainability index from 0 to 100: volume, branches, statements and share of comments (DET-20).

    Statements are counted in the tree; text of several lines that stands alone counts as comment.
    """
    notes, code = 0, set()
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            notes += 1
        elif t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            code.update(range(t.start[0], t.end[0] + 1))
    alone = {n for x in ast.walk(tree) if isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str) and x.end_lineno > x.lineno for n in range(x.lineno, x.end_lineno + 1)}
    statements = sum(isinstance(x, (ast.stmt, ast.ExceptHandler)) for x in ast.walk(tree))
    volume, lines = halstead_volume(tree), len(code - alone)
    if volume <= 0 or statements <= 0:
        return 100.0
    share = (notes + len(alone)) / lines * 100 if lines else 0.0
    # The index's weights.
    raw = 171 - 5.2 * math.log(volume) - 0.23 * (1 + branches) - 16.2 * math.log(statements) + 50 * math.sin(math.sqrt(2.46 * math.radians(share)))
    return min(max(raw * 100 / 171, 0.0), 100.0)


def bare(called: ast.expr) -> str:
    return called.attr if isinstance(called, ast.Attribute) else getattr(called, "id", "")


class Facts(ast.NodeVisitor):
    """Fact rows of one module."""

    BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.Assert, ast.comprehension)
    NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.ExceptHandler)
    # Names of entry points.
    ENTRIES = {"main", "handler", "handle_request", "run"}

    def __init__(self, path: str):
        self.path, self.rows, self.alias, self.owner, self.places = path, [], {}, "", {}

    def add(self, kind: str, name: str, node: ast.AST | None, **more) -> None:
        row = {"path": self.path, "kind": kind, "name": name, "line": getattr(node, "lineno", 0), "end_line": getattr(node, "end_lineno", 0) or 0, "parameters": 0, "depth": 0, "complexity": 0, "cognitive": 0, "typed": False, "entry": False, "owner": self.owner, "place": 0, "value": 0.0, "detail": ""}
        self.rows.append(row | more)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.add("import", a.name, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module and not node.level:
            self.add("import", node.module, node)
            for a in node.names:
                self.alias[a.asname or a.name] = f"{node.module}.{a.name}"

    def dotted(self, node: ast.AST) -> str:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return ""
        return ".".join([self.alias.get(node.id, node.id), *reversed(parts)])

    def depth(self, node: ast.AST) -> int:
        return max((self.depth(c) + isinstance(c, self.NESTING) for c in ast.iter_child_nodes(node)), default=0)

    def cognitive(self, node: ast.AST, level: int = 0) -> int:
        total = 0
        for c in ast.iter_child_nodes(node):
            nests = isinstance(c, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.ExceptHandler))
            total += (1 + level) * nests + isinstance(c, (ast.Break, ast.Continue)) + (len(c.values) - 1 if isinstance(c, ast.BoolOp) else 0)
            total += self.cognitive(c, level + nests)
        return total

    def branches(self, node: ast.AST) -> int:
        inner = list(ast.walk(node))
        return sum(isinstance(x, self.BRANCHES) for x in inner) + sum(len(x.values) - 1 for x in inner if isinstance(x, ast.BoolOp))

    def module(self, text: str) -> None:
        """All rows of a module's text, with its way in and its maintainability."""
        tree = ast.parse(text)
        self.places = {id(x): i for i, x in enumerate(ast.walk(tree))}
        self.visit(tree)
        if found := entry_point(tree):
            self.add("entry_point", found[0], None, detail=found[1])
        self.add("module", "", None, value=maintainability(tree, text, self.branches(tree)))

    def function(self, node) -> None:
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        own = [a for a in args if a.arg not in ("self", "cls")]
        marks = {(d.attr if isinstance(d, ast.Attribute) else getattr(d, "id", "")).lower() for d in node.decorator_list}
        hints = {"returns": ast.unparse(node.returns) if node.returns else None, "parameters": [{"name": a.arg, "hint": ast.unparse(a.annotation) if a.annotation else None} for a in node.args.args]}
        self.add("function", node.name, node, parameters=len(args), depth=self.depth(node), complexity=1 + self.branches(node), cognitive=self.cognitive(node), typed=node.returns is not None and all(a.annotation for a in own), entry=node.name.lower() in self.ENTRIES or bool(marks & ROUTES), place=self.places.get(id(node), 0), detail=json.dumps(hints))
        for name in sorted({bare(x.func) for x in ast.walk(node) if isinstance(x, ast.Call)} - {""}):
            self.add("calls", name, node, owner=node.name, place=self.places.get(id(node), 0))
        before, self.owner = self.owner, node.name
        self.generic_visit(node)
        self.owner = before

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_Call(self, node: ast.Call) -> None:
        if name := self.dotted(node.func):
            self.add("call", name, node)
        if name := bare(node.func):
            self.add("call_site", name, node)
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if name := self.dotted(node):
            self.add("attribute", name, node)
        self.add("reference", node.attr, node)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.add("reference", node.id, node)


def syntax_facts(files: DataFrame) -> DataFrame:
    """Functions with their measures, imports, calls, attributes and references; ``error`` rows for code that doesn't parse.

    A function's ``calls`` rows name what it calls, also within inner functions; ``place`` is a node's rank by level.
    DET-10 to DET-13, DET-18 to DET-22, DET-25, DET-26, DET-31, DET-37, DET-42, TXT-25, TXT-28, TXT-29, TXT-45.
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                facts = Facts(path)
                try:
                    facts.module(text or "")
                except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
                    facts.rows = []
                    facts.add("error", "syntax", None)
                rows += facts.rows
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(go, FACTS)


def smells(facts: DataFrame, length: int = 50, parameters: int = 5, depth: int = 4, complexity: int = 10, cognitive: int = 15) -> DataFrame:
    """Functions beyond a threshold, one row for each measure (DET-18, DET-19, DET-21)."""
    f = facts.filter("kind = 'function'").withColumn("length", C("end_line") - C("line") + 1)
    over = lambda column, limit: C(column) - limit
    hit = lambda column, limit, priority, severity: F.when(C(column) > limit, F.struct(F.lit(column).alias("metric"), C(column).alias("value"), priority.cast("double").alias("priority"), severity.alias("severity")))
    low = F.lit("medium")
    found = F.array_compact(
        F.array(
            hit("length", length, 70 + F.least(over("length", length), F.lit(50)), low),
            hit("parameters", parameters, 60 + 5 * over("parameters", parameters), low),
            hit("depth", depth, 80 + 10 * over("depth", depth), F.when(C("depth") > 6, "high").otherwise("medium")),
            hit("complexity", complexity, F.least(F.lit(200), 80 + 5 * over("complexity", complexity)), F.when(C("complexity") > 30, "critical").when(C("complexity") > 10, "high").otherwise("medium")),
            hit("cognitive", cognitive, F.least(F.lit(200), 70 + 5 * over("cognitive", cognitive)), low),
        )
    )
    return f.select("path", "name", "line", F.explode(found).alias("s")).select("path", "name", "line", "s.*")


def low_maintainability(facts: DataFrame) -> DataFrame:
    """Files whose index isn't above 19 (DET-20)."""
    grade = F.when(C("value") > 9, "B").otherwise("C")
    rows = facts.filter("kind = 'module' and value <= 19").select("path", F.lit(1).alias("line"), "value", grade.alias("grade"))
    return rows.withColumn("severity", F.when(C("grade") == "C", "high").otherwise("medium")).withColumn("priority", F.least(F.lit(200.0), 60 + 3 * (20 - C("value"))))


def dangerous_calls(facts: DataFrame) -> DataFrame:
    """Calls that run text as code (DET-37)."""
    return facts.filter((C("kind") == "call") & C("name").isin("eval", "exec", "compile", "__import__"))


def import_edges(facts: DataFrame) -> DataFrame:
    """Module to top-level package (GR-1, GR-2)."""
    module = F.replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))
    return facts.filter("kind = 'import'").select(module.alias("src"), F.get(F.split("name", r"\."), F.lit(0)).alias("dst")).distinct()
