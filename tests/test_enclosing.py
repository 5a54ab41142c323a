"""Enclosing functions: each place is answered once, and no pair of a finding and a function is made."""

import random

from pyspark.sql import functions as F

from plumbline.operators import matching, ranking

FUNCTIONS = "file string, name string, start_line int, end_line int, seq int"


def most_rows(spark):
    """The rows that came out of the largest step of the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    metrics, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    found = []
    for i in range(nodes.size()):
        known = nodes.apply(i).metrics()
        ids = [known.apply(j).accumulatorId() for j in range(known.size()) if known.apply(j).name() == "number of output rows"]
        found += [int(metrics.apply(x).replace(",", "")) for x in ids if metrics.contains(x)]
    return max(found)


def test_functions_inside_each_other(spark):
    n, rnd = 2000, random.Random(8)
    seqs = rnd.sample(range(n), n)
    functions = [("f", f"fn{seqs[i]}", i, 2 * n - i, seqs[i]) for i in range(n)]
    findings = [(p, "f", 2 * p) for p in range(n)]
    got = ranking.enclosing_function(spark.createDataFrame(findings, "seq int, file string, line int"), spark.createDataFrame(functions, FUNCTIONS)).collect()
    assert most_rows(spark) < 100_000  # 2,000,000 pairs meet
    least = [min(seqs[: i + 1]) for i in range(n)]
    holding = {p: min(2 * p, 2 * n - 2 * p, n - 1) for p in range(n)}
    assert {r.seq: (r.function, r.n_holding) for r in got} == {p: (f"fn{least[i]}", i + 1) for p, i in holding.items()}


def test_against_each_with_each(spark):
    rnd = random.Random(9)
    lengths = [0, 1, 2, 3, 7, 8, 40, 63, 64, 700, -2]
    functions = [(rnd.choice(["f0", "f1", "f2", None]), f"fn{i}", s := rnd.randint(-300, 500), s + rnd.choice(lengths), i) for i in range(300)]
    functions += [("f0", "open", 1, None, 900), ("f0", "odd", None, 9, 901), ("f9", "all", -(2**31), 2**31 - 1, 902)]
    findings = [(rnd.randint(0, 250), rnd.choice(["f0", "f1", "f3", "f9", None]), rnd.choice([None, rnd.randint(-400, 900)])) for _ in range(400)] + [(999, "f9", -(2**31)), (998, "f9", 2**31 - 1)]
    want = {}
    for seq, file, line in findings:
        for g, name, a, b, fseq in functions:
            if file is not None and file == g and None not in (line, a, b) and a <= line <= b:
                first, n = want.get(seq, ((fseq, name), 0))
                want[seq] = (min(first, (fseq, name)), n + 1)
    f = spark.createDataFrame(functions, FUNCTIONS)
    p = spark.createDataFrame(findings, "seq int, file string, line int")
    got = ranking.enclosing_function(p, f)
    assert {r.seq: (r.function, r.n_holding) for r in got.collect()} == {s: (name, n) for s, ((_, name), n) in want.items()}
    assert ranking.enclosing_function(p, f.limit(0)).count() == 0 and ranking.enclosing_function(p.limit(0), f).count() == 0


def test_order_decides_within_a_place(spark):
    spans = spark.createDataFrame([("f", 1, 9, 5), ("f", 4, 4, 3), ("f", 4, 12, 7)], "file string, first int, last int, rank int")
    points = spark.range(14).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line"))
    got = {r.line: (r["rank"], r.n_holding) for r in matching.first_within(points.unionAll(points), spans, ["file"], "line", "first", "last", "rank").collect()}
    assert got == {**{x: (5, 1) for x in (1, 2, 3)}, 4: (3, 3), **{x: (5, 2) for x in range(5, 10)}, **{x: (7, 1) for x in (10, 11, 12)}}
