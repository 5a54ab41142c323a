import random

from pyspark.sql import functions as F

from plumbline.functions import dims
from plumbline.operators import detect, forecast, graph, ranking, reports, scoring
from plumbline.sources import files, formats


def test_unified_priority_values(spark):
    rows = [("medium", 1.0, 1.0, "medium", 10.0), ("critical", 2.0, 2.0, "low", 200.0), ("critical", 5.0, 5.0, "low", 200.0)]
    got = scoring.unified_priority(spark.createDataFrame(rows, "severity string, urgency double, impact double, effort string, want double"))
    assert got.filter("priority <> want").count() == 0


def test_regression_and_trend(spark):
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    r = forecast.regression(points).first()
    assert abs(r.slope - 2) < 0.01 and abs(r.intercept) < 0.01
    flat = forecast.regression(spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "x double, y double")).first()
    assert (flat.slope, flat.intercept) == (0.0, 4.0)
    t = spark.range(1).select(*[forecast.trend(F.lit(s)).alias(f"c{i}") for i, s in enumerate((-0.1, 0.0, 0.1))]).first()
    assert list(t) == ["improving", "stable", "worsening"]


def test_success_rates(spark):
    rows = [("a", "merged")] * 8 + [("a", "rejected")] * 2 + [("b", "pending")]
    got = {r.team: (r.rate, r.adjustment) for r in reports.success_rates(spark.createDataFrame(rows, "team string, status string"), "team").collect()}
    assert got["b"] == (1.0, 0) and abs(got["a"][0] - 0.8) < 1e-9 and got["a"][1] >= 1


def test_failure_trend(spark):
    rows = [(i, f"2024-01-{i:02d}", i <= 5, "t") for i in range(1, 11)]
    assert reports.failure_trend(spark.createDataFrame(rows, "seq int, timestamp string, success boolean, team string")).first().trend == "degrading"


def test_batches_hold_their_size(spark):
    rows = [(i, f"src/f{i}.py") for i in range(5)]
    got = ranking.batches(spark.createDataFrame(rows, "seq int, file string"), max_files=2).groupBy("batch").count().collect()
    assert len(got) == 3 and max(r["count"] for r in got) <= 2


def test_first_row_wins_whatever_the_order(spark):
    rows = [(3, "k", "c"), (1, "k", "a"), (2, "k", "b")]
    assert ranking.first_of(spark.createDataFrame(rows, "seq int, key string, v string"), "key").first().v == "a"
    assert ranking.last_of(spark.createDataFrame(rows, "seq int, key string, v string"), "key").first().v == "c"


def test_cyclic_graph_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert {r.node: r.hop for r in graph.reach(edges, graph.frame(spark, [1])).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert [r.members for r in graph.cycles(edges).collect()] == [[1, 2, 3]]


def test_deep_graphs_are_followed_to_the_end(spark):
    n = 54
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int").coalesce(1).cache()
    back = chain.select(F.col("dst").alias("src"), F.col("src").alias("dst")).cache()
    start, nodes = graph.frame(spark, [0]), spark.range(n + 1).select(F.col("id").cast("int").alias("node"))
    assert {r.node: r.hop for r in graph.reach(chain, start).collect()} == {i: i for i in range(n + 1)}
    assert graph.blast_radius(back, start).first().asDict() == {"direct": 1, "transitive": n - 1, "affected": n + 1, "radius": 1.0, "risk": "critical", "gate_passed": False}
    assert graph.blast_radius(back, start, spark.range(1100).select(F.col("id").alias("node"))).first().risk == "low"
    assert {r.node: r.path for r in graph.shortest_paths(chain, start).collect()} == {i: list(range(i + 1)) for i in range(n + 1)}
    assert {r.node: r.level for r in graph.levels(back, nodes).collect()} == {i: i for i in range(n + 1)}
    assert {r.status for r in graph.cascade(back, start, nodes).filter("node > 0").collect()} == {"rolled_back"}


def components_by_search(edges):
    """Least node of every node that lies on a cycle, by a search from each node."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    reached = {}
    for x in after:
        seen, todo = {x}, [x]
        while todo:
            todo += (new := after[todo.pop()] - seen)
            seen |= new
        reached[x] = seen
    least = {x: min(y for y in reached[x] if x in reached[y]) for x in after}
    return {x: c for x, c in least.items() if list(least.values()).count(c) > 1}


def test_cycles(spark, monkeypatch):
    """Components equal those of a plain search; each walk is closed and in one; without the edges that lead back no cycle is left."""
    rnd = random.Random(3)
    ring = [(i, (i + 1) % 7) for i in range(7)]
    for block, edges in ((500_000, [*ring, (2, 0), (3, 5), (5, 3), (7, 8), (8, 9), (6, 7), (4, 4)]), (4, [(rnd.randrange(40), rnd.randrange(40)) for _ in range(65)])):
        monkeypatch.setattr(graph, "BLOCK", block)
        df = spark.createDataFrame(edges, "src int, dst int")
        want = components_by_search(edges)
        assert {r.node: r.component for r in graph.strong_components(df).collect()} == want
        walks = graph.closed_walks(df).collect()
        for r in walks:
            path = list(r.path)
            assert path[0] == r.dst and path[-1] == r.src and {want[x] for x in path} == {r.component}
            assert all(e in set(edges) for e in zip(path, path[1:] + path[:1], strict=True))
        back = {(r.src, r.dst) for r in walks}
        assert len(back) == len(walks) and components_by_search([e for e in edges if e not in back and e[0] != e[1]]) == {}
    assert {tuple(r.members) for r in graph.cycles(spark.createDataFrame(ring, "src int, dst int")).collect()} == {tuple(range(7))}


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    """Nodes in random order; distances, levels and one asked chain; rounds in the logarithm of the length."""
    rounds, changes = [], graph.changes
    monkeypatch.setattr(graph, "changes", lambda *a: rounds.append(1) or changes(*a))
    n = 10_000
    order = list(range(n))
    random.Random(2).shuffle(order)
    chain = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "src int, dst int").coalesce(2).cache()
    found = dict(graph.reach(chain, graph.frame(spark, order[:1])).collect())
    assert found == {x: i for i, x in enumerate(order)} and len(rounds) < 20
    up = spark.createDataFrame([(x, i, order[i - 1] if i else None) for i, x in enumerate(order)], "node int, value long, parent int")
    (path,) = graph.chains(up, graph.frame(spark, [order[-1]])).collect()
    assert list(path.path) == order


def test_levels_of_a_cycle_are_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="cycle"):
        graph.levels(spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int"), graph.frame(spark, [1, 2]))


def test_versions(spark):
    pairs = [("2.8", "2.8.0", True), ("2.10", "2.9", False), ("none", "1.2", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", (dims.version(F.col("a")) < dims.version(F.col("b"))).alias("got"))
    assert df.filter("want <> got").count() == 0


def test_globs_cross_slashes(spark):
    df = spark.createDataFrame([("src/build/x.py",), ("build/x.py",), ("src/x.py",)], "path string")
    assert [r.path for r in detect.excluded(df, ["**/build/**"]).collect()] == ["src/x.py"]


def test_masks(spark):
    got = spark.createDataFrame([("password=abc, rest",)], "t string").select(detect.masked(F.col("t")).alias("m")).first().m
    assert got == "password=***REDACTED***, rest"


def test_junit_and_audit(spark):
    xml = "<testsuite><testcase/><testcase><failure/></testcase><testcase><skipped/></testcase></testsuite>"
    r = formats.junit_counts(spark.createDataFrame([(xml,)], "report string")).first()
    assert (r.run, r.failed, r.skipped, r.passed) == (3, 1, 1, 1)
    audit = '{"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "V1", "fix_versions": ["2"]}]}, {"name": "b", "version": "1", "vulns": []}]}'
    assert [tuple(x) for x in formats.audit_report(spark.createDataFrame([(audit,)], "report string")).collect()] == [("a", "1", "V1", "HIGH")]


def test_source_tree_and_syntax_facts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import numpy as np\n\ndef _unused(x):\n    if x:\n        for i in x:\n            np.float(i)\n\ndef used(a: int) -> int:\n    return eval(a)\n")
    (tmp_path / "src/bad.py").write_text("def broken(:\n")
    (tmp_path / "pyproject.toml").write_text('[project]\ndependencies = ["requests>=2", "numpy"]\n')
    found = files.source_files(spark, str(tmp_path), ["py"], excludes=["**/bad.py"])
    assert [r.path for r in found.collect()] == ["src/a.py"]
    facts = files.syntax_facts(files.source_files(spark, str(tmp_path), ["py"])).collect()
    kinds = {(f.kind, f.name) for f in facts}
    assert {("function", "_unused"), ("function", "used"), ("import", "numpy"), ("call", "numpy.float"), ("call", "eval"), ("error", "syntax")} <= kinds
    f = {x.name: x for x in facts if x.kind == "function"}
    assert f["_unused"].depth == 2 and f["used"].typed and not f["_unused"].typed and f["_unused"].complexity == 3
    deps = files.toml_dependencies(files.source_files(spark, str(tmp_path), ["toml"])).collect()
    assert {(d.package, d.spec) for d in deps} == {("requests", ">=2"), ("numpy", "")}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "seq int, type string, severity string, file string, description string")
    assert reports.by_type_and_severity(none).count() == 0
    assert reports.review_summary(none).first().risk == "none"


def test_positions_at_scale(spark):
    """Over many partitions and with ties, positions are those of row_number and no row is lost."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        n = 400_000
        df = spark.range(n).select(F.col("id").alias("seq"), (F.xxhash64("id") % 900).cast("double").alias("priority_score"), (F.xxhash64("id", F.lit(1)) % 50).cast("double").alias("business_impact_score"), F.repeat(F.lit("x"), 40).alias("pad"))
        got = ranking.prioritised(df).select("seq", "score", "position")
        placed = got.toPandas().sort_values("position")
        assert placed["position"].tolist() == list(range(1, n + 1))
        keys = list(zip((-placed["score"]).tolist(), placed["seq"].tolist(), strict=True))
        assert keys == sorted(keys)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_graph_has_no_depth_cap(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "src int, dst int")
    assert graph.reach(chain, graph.frame(spark, [0])).count() == 31
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(9, 0)], "src int, dst int")
    assert [list(r.members) for r in graph.cycles(ring).collect()] == [[0, 1, 2, 3, 4, 5]]


def test_failing_scanner_gives_a_row(spark):
    from plumbline.functions.settings import Registry

    files = spark.createDataFrame([("a.py", "x")], "path string, text string")
    r = Registry()
    r.register("good", lambda f: f.select("path"))
    r.register("broken", lambda f: f.select("nothing_like_it"))
    r.register("late", lambda f: f.selectExpr("path", "cast(text AS int) AS n"))
    rows = r.scan(files).collect()
    assert sum(x.path == "a.py" for x in rows) == 1 and {x.scanner for x in rows if x.scan_error} == {"broken", "late"}
