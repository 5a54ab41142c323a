import pytest

from plumbline.plans import catalogue

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(name, same):
    same(name, catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_queries_without_sql(spark, duck):
    """The run over files finds what the SQL of its scanners finds, and deals the best of it."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"full_run", "run_report"}
    report = {r.scanner: r for r in catalogue.QUERIES["run_report"](spark, DATA).collect()}
    count = lambda name: duck.execute(f"SELECT count(*) FROM ({catalogue.ORACLE[name]})").fetchone()[0]
    assert report["security_patterns"].found == count("security_pattern_scan") and report["todo_comments"].found == count("todo_scan")
    assert all(r.scan_error == "" and r.batched <= r.fresh <= r.found for r in report.values())
    rows = catalogue.QUERIES["full_run"](spark, DATA).collect()
    assert len(rows) == sum(r.batched for r in report.values()) <= 25 and len({r.batch for r in rows}) <= 5
    assert min(r.position for r in rows) == 1 and all(r.file.startswith(r.folder) for r in rows)
