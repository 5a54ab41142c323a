"""The run from files to batches, against the same steps over collected findings."""

from plumbline.functions.settings import Registry
from plumbline.sources import runs, trees


def test_full_run(spark, tmp_path):
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "lib").mkdir()
    (tmp_path / "src/a/one.py").write_text("# TODO first\nimport os\nos.system('ls')\n# TODO first\n")
    (tmp_path / "src/a/two.py").write_text("password = 'hunter22'\n# FIXME now\n")
    (tmp_path / "lib/x.py").write_text("eval(x)\n")
    tree = trees.read_tree(spark, str(tmp_path), ["py"])
    seen = spark.createDataFrame([], "dedup_key string")
    batches, report = runs.full_run(tree, seen)
    rows = batches.collect()
    found = runs.scanned(tree).filter("scan_error IS NULL").collect()
    keys = {(r.type, r.file, r.line, r.description) for r in found}
    assert len(rows) == len(keys) > 5 and [r.position for r in sorted(rows, key=lambda r: r.position)] == list(range(1, len(keys) + 1))
    score = {r.seq: r.priority_score for r in found}
    order = [(-score[r.seq], r.seq) for r in sorted(rows, key=lambda r: r.position)]
    assert order == sorted(order)
    assert {r.folder for r in rows} == {"src/a", "lib"} and all(len({x.folder for x in rows if x.batch == b}) == 1 for b in {r.batch for r in rows})
    by = {r.scanner: r for r in report.collect()}
    assert by["security_patterns"].found >= 3 and by["security_patterns"].batched == by["security_patterns"].fresh and all(r.scan_error is None for r in by.values())
    lines = runs.report_lines(batches).collect()
    assert sum(r.findings for r in lines) == len(rows) and "critical" in {r.worst for r in lines}
    # a second run over the same tree has nothing new
    again, report = runs.full_run(tree, batches.select("dedup_key"))
    assert again.count() == 0 and sum(r.fresh for r in report.collect()) == 0


def test_a_failing_scanner_is_reported(spark):
    registry = Registry()
    registry.register("broken", lambda f: f.select("nothing"))
    files = spark.createDataFrame([("a.py", "py", "x")], "path string, ext string, text string")
    batches, report = runs.full_run(files, spark.createDataFrame([], "dedup_key string"), registry=registry)
    (row,) = report.collect()
    assert batches.count() == 0 and row.found == 0 and "nothing" in row.scan_error
