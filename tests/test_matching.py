"""Index joins and keyed running sums against comparing everything with everything."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph, matching, records, reports, running, scoring


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_containing_and_ending(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abé/") for _ in range(n))
    texts = [word(rnd.randint(0, 12)) for _ in range(120)] + ["common abab"] * 60 + [None, "", "a"]
    needles = [word(rnd.randint(0, 5)) for _ in range(80)] + ["abab", "zzz", None, "", "a", "common abab and more"]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    known = [(x, y) for x in set(texts) for y in set(needles) if x is not None and y]
    found = matching.containing(t, n)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted((x, y) for x, y in known if y in x)
    assert sorted(map(tuple, matching.ending(t, n).collect())) == sorted((x, y) for x, y in known if x.endswith(y))
    either = matching.ending_either_way(t, n)
    assert sorted(map(tuple, either.collect())) == sorted((x, y) for x, y in known if x and (x.endswith(y) or y.endswith(x)))
    assert matching.containing(t.limit(0), n).count() == 0 and matching.ending(t, n.limit(0)).count() == 0


def test_within(spark):
    rnd = random.Random(5)
    spans = [(i, f"f{i % 3}", s := rnd.randint(0, 500), s + rnd.choice([0, 1, 3, 40, 700, -2])) for i in range(150)]
    points = [(i, f"f{i % 4}", rnd.randint(0, 900)) for i in range(200)]
    got = matching.within(spark.createDataFrame(points, "p int, file string, line int"), spark.createDataFrame(spans, "s int, file string, first int, last int"), ["file"], "line", "first", "last")
    assert "NestedLoop" not in plan(got)
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, f, x in points for s, g, a, b in spans if f == g and a <= x <= b)


def test_one_file_with_very_many_functions(spark):
    n = 100_000
    spans = spark.range(n).select(F.col("id").alias("s"), F.lit("f").alias("file"), (F.col("id") * 3).alias("first"), (F.col("id") * 3 + 1).alias("last"))
    points = spark.range(n).select(F.col("id").alias("p"), F.lit("f").alias("file"), (F.col("id") * 3 + 1).alias("line"))
    got = matching.within(points, spans, ["file"], "line", "first", "last")
    assert got.filter("p = s").count() == n == got.count()


@pytest.mark.parametrize("least", [False, True])
def test_running(spark, least):
    """One key with nearly all rows, a null key, nulls and ties: over several blocks."""
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot"] * 9 + ["cold", None]), rnd.randint(0, 50), i, rnd.choice([None, 1, 2, 3, -4])) for i in range(3000)]
    df = spark.createDataFrame(rows, "team string, at int, seq int, v int").repartition(8)
    out = running.running(df, ["team"], [F.asc("at"), F.asc("seq")], F.col("v"), "upto", least)
    got = {r.seq: (r.upto, r.upto_all) for r in out.collect()}
    for team in ("hot", "cold", None):
        seen = [r[3] for r in sorted((r for r in rows if r[0] == team), key=lambda r: (r[1], r[2]))]
        order = [r[2] for r in sorted((r for r in rows if r[0] == team), key=lambda r: (r[1], r[2]))]
        fold = (lambda x: min(x, default=None)) if least else sum
        known = [x for x in seen if x is not None]
        assert all(got[s] == (fold([x for x in seen[: i + 1] if x is not None]), fold(known)) for i, s in enumerate(order) if not (i == 0 and seen[0] is None))


def test_a_team_is_spread_over_blocks(spark, monkeypatch):
    kept, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    df = spark.range(20_000).select(F.lit("one").alias("team"), F.col("id").alias("seq"), F.lit(1.0).alias("cost_usd"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = reports.running_spend(df, 500)
        assert out.agg(F.max("running")).first()[0] == 20_000.0 and out.filter("running <> seq + 1").count() == 0
        sizes = [r[0] for r in kept[0][0].groupBy("_part").count().select("count").collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * 5_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_reprioritise_against_each_with_each(spark):
    rnd = random.Random(7)
    findings = [(i, rnd.choice(["src\\A.py", "src/a.py", "lib/b.py", "b.py", "x/deep/a.py"]), rnd.choice(["Lib1", "lib2", None]), rnd.choice(["", "CVE-1", None]), rnd.choice(["uses cve-2", "plain", None]), float(rnd.randint(0, 90)), float(rnd.randint(0, 60))) for i in range(60)]
    kinds = ["production_incident", "cve_announced", "deadline_approaching", "budget_exceeded", "team_capacity_change", "custom"]
    events = [(e, rnd.choice(kinds), rnd.choice(["a.py", "src/a.py", "repo/src/a.py", "lib", "lib2", "cve-1", "CVE-2", "deep", ""]), rnd.choice([10.0, -20.0, 35.0]), rnd.choice([0.2, 0.9])) for e in range(1, 25)]
    low = lambda x: (x or "").lower()
    want = set()
    for seq, file, library, cve, text, score, impact in findings:
        paused, boosts = False, 0
        for _, kind, target, boost, ratio in events:
            a, b, t = low(file).replace("\\", "/"), target.lower().replace("\\", "/"), target.lower()
            in_library = t in low(library) and library is not None
            hit = t != "" and {"production_incident": a.endswith(b) or b.endswith(a), "cve_announced": t in low(cve) or in_library or t in low(text), "deadline_approaching": in_library, "custom": t in low(file)}.get(kind, False)
            if hit:
                score, boosts = score + boost, boosts + (boost > 0)
            paused |= kind == "budget_exceeded" and score + impact < 100 or kind == "team_capacity_change" and ratio < 0.5 and score < 50
        want.add((seq, score, paused, boosts))
    f = spark.createDataFrame(findings, "seq int, file string, library string, cve string, description string, priority_score double, business_impact_score double")
    e = spark.createDataFrame(events, "eseq int, kind string, target string, boost double, ratio double")
    out = scoring.reprioritise(f, e)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert {(r.seq, r.priority, r.paused, r.n_boosts) for r in out.collect()} == want
    assert scoring.active(out).count() == sum(not w[2] for w in want)
    assert {r.priority for r in scoring.reprioritise(f, e.limit(0)).collect()} == {x[5] for x in findings}


def test_open_proposals_without_a_description(spark):
    f = spark.createDataFrame([(1, ""), (2, "slow query"), (3, None), (4, "x")], "seq int, description string")
    i = spark.createDataFrame([(9, "[Proposal] slow query here", "open"), (5, "[Proposal] other", "open"), (1, "slow query", "open"), (2, "[Proposal] slow query", "closed")], "number int, title string, state string")
    assert dict(records.open_proposals(f, i).select("seq", "duplicate").collect()) == {1: 5, 2: 9, 3: None, 4: None}
