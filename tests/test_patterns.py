"""Literal factors of patterns: they are in every match, and the guarded test finds what the bare one finds."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import dims, patterns
from plumbline.operators import detect
from plumbline.sources.adaptors import MARKERS

CASES = [("ab?c", ["a", "ac", "abc"]), (r"x{2,3}yz", ["xxyz", "yz"]), (r"(?i)Key\s*=", ["KEY =", "key="]), ("a|bc", ["a", "bc", "x"]), (r"[a|b]c\.d", ["|c.d", "acxd"]), (r"(?:one|two) th+ree", ["one three", "two thhree"]), (r"\bfoo\(", ["foo(", "xfoo("]), ("a*", ["", "b"])]


@pytest.mark.parametrize(("pattern", "texts"), CASES)
def test_factors_are_in_every_match(pattern, texts):
    for t in texts:
        if (m := re.search(pattern, t)) is not None:
            assert any(patterns.factor(p) in m[0] for p in patterns.alternatives(pattern))


def test_guarded_rules_find_the_same(spark):
    lines = [*MARKERS, "", "nothing", "PASSWORD='abcd'", 'x = Statement.execute("a" + b)', "from Crypto.Cipher import DES", '"crypto/sha1"', "db.Exec(q + x)", "yaml.load(x)", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_no int, text string")
    got = {(r.line_no, r.rule) for r in detect.rule_hits(df).collect()}
    want = {(i, n) for i, t in enumerate(lines) for n, rule in enumerate(dims.SECURITY_RULES) if t is not None and re.search(rule[1], t)}
    assert got == want and len({n for _, n in got}) > 15
    for pattern, texts in CASES:
        some = spark.createDataFrame([(t,) for t in texts], "text string")
        assert some.filter(patterns.matches(F.col("text"), pattern) != F.col("text").rlike(pattern)).count() == 0


def test_impact_of_each_category(spark):
    rows = detect.with_impact(spark.createDataFrame([(c,) for c in [*dims.COMPLIANCE, "own"]], "category string")).collect()
    for r in rows:
        assert r.exploit_scenario == dims.EXPLOIT_SCENARIOS.get(r.category, "") and list(r.compliance) == dims.COMPLIANCE.get(r.category, [])
