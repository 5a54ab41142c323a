import ast
import math

from pyspark.sql import functions as F

from plumbline.operators import code
from plumbline.sources import files

APP = '''import os, nowhere.deep as d
from .near import x

@app.get
def root(a, b: int = 1) -> str:
    def inner():
        return helper(a)
    return inner()

def helper(y):
    return y + 1

def lonely():
    return d.gone()
'''
TESTS = "def test_helper():\n    assert helper(1) == 2\n\ndef test_other():\n    assert 1\n"


def tree(spark):
    rows = [("src/app.py", APP), ("tests/test_app.py", TESTS), ("src/bad.py", "def ("), ("src/none.py", None), ("src/empty.py", "")]
    f = spark.createDataFrame(rows, "path string, text string")
    return f, files.syntax_facts(f).cache()


def test_reachability_of_functions(spark):
    _, facts = tree(spark)
    findings = spark.createDataFrame([(1, "src/app.py", 11, 100.0), (2, "src/app.py", 14, 100.0), (3, "src/app.py", 1, 100.0), (4, "src/app.py", 5, 190.0), (5, "a.js", 11, 7.0)], "seq int, file string, line int, priority_score double")
    got = {r.seq: r for r in code.with_reachability(findings, facts).collect()}
    assert got[1].call_chain == ["root", "helper"] and got[1].reachable and math.isclose(got[1].priority_score, 110)
    assert got[2].enclosing == "lonely" and got[2].reachable is False and got[2].call_chain is None and got[2].priority_score == 100
    assert got[3].enclosing is None and got[3].reachable is None and got[5].priority_score == 7
    assert got[4].enclosing == "root" and got[4].priority_score == 200


def test_last_definition_of_a_name_counts(spark):
    rows = [("a.py", "def main():\n    shared()\n\ndef shared():\n    old()\n\ndef old():\n    pass\n"), ("b.py", "def shared():\n    new()\n\ndef new():\n    pass\n")]
    facts = files.syntax_facts(spark.createDataFrame(rows, "path string, text string"))
    got = {r.name: r.call_chain for r in code.reachable_functions(facts).collect()}
    assert got == {"main": ["main"], "shared": ["main", "shared"], "new": ["main", "shared", "new"], "old": None}


def test_tests_sites_listing_hints_imports(spark):
    f, facts = tree(spark)
    assert {(r.path, r.test, r.name) for r in code.covering_tests(facts, f, ["helper", "lonely"]).collect()} == {("tests/test_app.py", "test_helper", "helper")}
    sites = code.call_sites(facts, ["helper", "gone"], 1).orderBy("name").collect()
    assert [(r.name, r.path, r.line, r.n) for r in sites] == [("gone", "src/app.py", 14, 1), ("helper", "src/app.py", 7, 2)]
    lines = APP.splitlines()
    listing = code.numbered_source(facts, f).filter("name = 'helper'").first().listing
    assert listing == "\n".join(f"{i + 1:4d} | {lines[i]}" for i in range(4, min(len(lines), 16)))
    hints = code.type_hints(facts).filter("name = 'root'").first()
    assert hints.returns == "str" and [(p.name, p.hint) for p in hints.parameters] == [("a", None), ("b", "int")]
    known = spark.createDataFrame([("os",)], "module string")
    assert [(r.path, r.name) for r in code.missing_imports(facts, known).collect()] == [("src/app.py", "nowhere.deep")]


def test_frameworks():
    marks = {"@app.route('/')": "flask", "@bp.get('/')": "flask", "@router.post('/')": "fastapi", "@router.post": "flask", "@x.y.route('/')": "flask", "@app.task": None, "@get('/')": None}
    for text, want in marks.items():
        assert files.route_kind(ast.parse(f"{text}\ndef f(): pass").body[0].decorator_list[0]) == want, text
    assert files.entry_point(ast.parse("if __name__ == '__main__':\n    go()\n\nclass V(View):\n    pass\n")) == ("django", "class V")
    assert files.entry_point(ast.parse("def handler(event): pass")) is None


def test_maintainability(spark):
    text = "# a note\nx = a + b\ny = a * 2\n"
    # Two signs and four sides over {Add, Mult, a, b, 2}; two statements; one comment on two lines.
    volume = 6 * math.log2(5)
    raw = 171 - 5.2 * math.log(volume) - 0.23 - 16.2 * math.log(2) + 50 * math.sin(math.sqrt(2.46 * math.radians(50)))
    assert math.isclose(files.maintainability(ast.parse(text), text, 0), min(raw * 100 / 171, 100))
    assert files.maintainability(ast.parse("import os\n"), "import os\n", 0) == 100
    rows = [("good.py", text), ("bad.py", "\n".join(f"if a{i} > {i} and b{i} < {i}:\n    c{i} = a{i} + b{i} * {i}" for i in range(400)))]
    got = files.low_maintainability(files.syntax_facts(spark.createDataFrame(rows, "path string, text string"))).collect()
    assert [(r.path, r.grade, r.severity) for r in got] == [("bad.py", "C", "high")] and math.isclose(got[0].priority, min(200, 60 + 3 * (20 - got[0].value)))


def test_facts_of_broken_and_empty_files(spark):
    _, facts = tree(spark)
    kinds = {r.path: set(r.kinds) for r in facts.groupBy("path").agg(F.collect_set("kind").alias("kinds")).collect()}
    assert kinds["src/bad.py"] == {"error"} and kinds["src/empty.py"] == kinds["src/none.py"] == {"module"}
