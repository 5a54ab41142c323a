import pytest
from pyspark.sql import functions as F

from plumbline.functions.settings import settings
from plumbline.streaming import commits
from plumbline.sources import files, scanners, sinks

TREE = [
    ("a/x.py", "py", "import b.y\nimport numpy as np\n# TODO: tidy\ndef f(p, q, r, s, t, u):\n    return np.float(p)\nh = hashlib.md5(z)\n"),
    ("b/y.py", "py", "import a.x\n"),
    ("requirements.txt", "txt", "requests==2.0\n"),
    ("web/s.js", "js", "// FIXME later\n"),
]


def test_default_registry_finds_each_kind(spark):
    tree = spark.createDataFrame(TREE, "path string, ext string, text string")
    registry = scanners.default_registry()
    assert len(registry.enabled()) == 7
    found = registry.scan(tree).collect()
    assert not any("scan_error" in r.asDict() for r in found), [r for r in found if r.asDict().get("scan_error")]
    seen = {(r.scanner, r.file, r.line) for r in found}
    want = {("deprecated_apis", "a/x.py", 5), ("todo_comments", "a/x.py", 3), ("todo_comments", "web/s.js", 1), ("code_smells", "a/x.py", 4), ("security_patterns", "a/x.py", 6), ("type_coverage", "a/x.py", 1), ("dependency_upgrades", "requirements.txt", 1), ("architectural_drift", "a/__init__.py", 1)}
    assert want <= seen, want - seen
    assert registry.scan(tree.limit(0)).count() == 0


def test_settings_choose_scanners(spark):
    s = settings({"scanners": {"todo_comments": {"enabled": False}, "security_patterns": {"detect_weak_crypto": False}}})
    registry = scanners.default_registry(s)
    assert "todo_comments" not in registry.enabled() and len(registry.enabled()) == 6
    tree = spark.createDataFrame(TREE, "path string, ext string, text string")
    assert registry.scan(tree, ["security_patterns"]).count() == 0


def test_settings_are_checked():
    assert settings()["behavior"]["max_prs_per_run"] == 5
    assert settings({"budget": {"monthly_budget": 1}}, {"budget": {"hard_limit": False}})["budget"] == {"monthly_budget": 1, "alert_thresholds": [50, 80, 90, 100], "hard_limit": False}
    for bad in ({"behavior": {"confidence_threshold": 11}}, {"forecasting": {"min_snapshots": 1}}, {"learning": {"target_success_rate": "x"}}, {"behavior": {"confidence_threshold": 3}}):
        with pytest.raises(ValueError):
            settings(bad)


def test_report_page_and_log(spark, tmp_path):
    summary = spark.createDataFrame([("2024-01", 3, 12.5)], "period string, fixes int, net double")
    by_type = spark.createDataFrame([("todo<b>", 2, 4.0), ("security", 1, 8.0)], "type string, n int, savings double")
    page = sinks.report_page(summary, by_type, "Savings & costs")
    assert "<td>period</td><td>2024-01</td>" in page and "todo&lt;b&gt;" in page and "<b>" not in page and 'value="0.5000"' in page and "Savings &amp; costs" in page
    assert page.index("security") < page.index("todo&lt;")
    log = spark.createDataFrame([(2, "edit"), (1, "backup")], "seq int, step string")
    sinks.transaction_log(log, str(tmp_path / "log"), "t1")
    assert [r.step for r in commits.read(spark, str(tmp_path / "log"), "seq int, step string").orderBy("seq").collect()] == ["backup", "edit"]


def test_ledgers_and_snapshots_read_back(spark, tmp_path):
    for month, text in (("2024-01", '{"seq": 1, "cost": 2.0}\nnot json\n'), ("2024-02", '{"seq": 2, "cost": 3.0}\n')):
        (tmp_path / f"ledger/period={month}").mkdir(parents=True)
        (tmp_path / f"ledger/period={month}/a.json").write_text(text)
    rows = files.monthly_ledger(spark, str(tmp_path / "ledger"), "seq long, cost double, period string")
    assert rows.agg(F.sum("cost")).first()[0] == 5 and files.monthly_ledger(spark, str(tmp_path / "ledger"), "seq long, cost double, period string", "2024-02").count() == 1
    (tmp_path / "snaps").mkdir()
    for name, text in (("abc-2.json", '{"n": 2}'), ("abc-1.json", '{"n": 1}'), ("zzz-1.json", '{"n": 9}'), ("abc-3.json", "{broken")):
        (tmp_path / "snaps" / name).write_text(text)
    assert [r.n for r in files.snapshots(spark, str(tmp_path / "snaps"), "abc", "n long").collect()] == [1, 2]


def test_advice_follows_the_trend(spark):
    from plumbline.operators import forecast

    rows = spark.createDataFrame([("worsening", 1.5, 140.0), ("improving", -1.0, 3.0)], "trend string, slope double, predicted double")
    assert {r.action for r in forecast.actions(rows).collect()} == {"Debt grows by 1.5 findings a day", "Plan a clean-up sprint", "Keep the present pace"}
