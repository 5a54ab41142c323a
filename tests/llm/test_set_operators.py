import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, components, neardup, sharding, topk

from .helpers import ascii_lower, corpus, empty, frame, words


def test_sharding(spark, tmp_path):
    docs = [(i, "x" * (i * 37 % 900), "en", "s", 1) for i in range(2000)] + [(None, "null id", "en", "s", 1), (3, "x" * 111, "en", "s", 1)]
    folder = f"file://{tmp_path}/maps"
    got = sharding.assign(frame(spark, docs), shards=8, map_folder=folder).collect()
    assert len(got) == len(docs)
    sizes, places = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 901
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    loaded = sharding.SlotMap.load(spark, folder)
    of = {r.vslot: r.bytes for r in sharding.slot_sizes(sharding.sizes(frame(spark, docs))).collect()}
    grown = loaded.grown(of)
    moved = [(a, b) for a, b in zip(loaded.shard_of, grown.shard_of, strict=True) if a != b]
    assert grown.version == 2 and moved and {b for _, b in moved} == {8} and max(grown.loads(of)) < max(loaded.loads(of)) + 1
    assert sharding.assign(empty(spark)).count() == 0


def test_topk(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=4)], 0) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], 0) for i in range(40)]
    rows += [(2000, None, 0), (2050, [1.0, None, 1.0, 1.0], 0), (2100, [float("nan")] * 4, 0), (2150, [], 0), (2200, [1.0, 2.0], 0), (2250, [1e10] * 4, 0), (None, [1.0] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit(1))
    topk.CANDIDATE_BLOCK, before = 64, topk.CANDIDATE_BLOCK
    try:
        got = topk.search(df, F.col("vec_id") % 50 == 0, 5).collect()
    finally:
        topk.CANDIDATE_BLOCK = before
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in good if i % 50 == 0):
        want = sorted((-min(sum(a * b for a, b in zip(good[q], v, strict=True)), 2**63 - 1), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("many", [False, True])
def test_topk_of_repeated_ids(spark, duck, monkeypatch, many):
    """Equal rows of an id are one query and one candidate, whether or not floors are sought first."""
    from plumbline.llm import queries

    if many:
        monkeypatch.setattr(topk, "SAMPLED_FROM", 0)
        monkeypatch.setattr(topk, "SAMPLE", 2)
        monkeypatch.setattr(topk, "CHUNK_BYTES", 100)
        monkeypatch.setattr(topk, "FAN", 2)
    again = [(i, [float(1 + i == 50), float(i)]) for i in range(44, 51)] + [(50, [0.0, 50.0])] * 2
    found = topk.search(spark.createDataFrame(again, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, 5).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in found] == [(1, 49), (2, 48), (3, 47), (4, 46), (5, 45)]
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=3)]) for i in range(1, 60)]
    rows += [(50, [9.0, 0.0, 0.0]), (50, [0.0, -9.0, 0.0]), (50, [1.0, 2.0]), (100, [1.0, 1.0]), (100, [0.0, 0.0, 5.0]), (100, [0.0, 0.0, 5.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect()
    values = ", ".join(f"({i}, {v})" for i, v in rows)
    sql = f"WITH embeddings AS (SELECT a::BIGINT AS vec_id, b::DOUBLE[] AS embedding FROM (VALUES {values}) AS t(a, b)), {queries.ORACLE['op7_exact_topk'].strip().removeprefix('WITH')}"
    assert sorted(tuple(r) for r in got) == sorted(duck.execute(sql).fetchall())


def brute(docs):
    sets = {}
    for d, t, *_ in docs:
        w = words(ascii_lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def family(n=90, seed=9):
    """Copies of one text that differ from each other more than from it; the least id is a far copy."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(220)]
    docs = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice([2, 4, 5, 6, 8])):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
        docs.append((i + 1, " ".join(w), "en", "s", 1))
    return docs


@pytest.mark.parametrize("block", [2048, 16])
@pytest.mark.parametrize("make", [corpus, family])
def test_near_duplicates(spark, make, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = make()
    want = brute(docs)
    got = neardup.near_duplicates(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    rows = neardup.near_duplicates(frame(spark, [(None, "a b c d e f", "en", "s", 1), (1, None, "en", "s", 1)])).collect()
    assert all(r.kept for r in rows) and len(rows) == 2


@pytest.mark.parametrize("hot", [False, True])
def test_near_filter_keeps_one_row_of_each_component(spark, monkeypatch, hot):
    """By rows, not ids: ids may repeat or be missing, and no column's name does harm."""
    if hot:
        monkeypatch.setattr(common, "HOT_PARTS", 3)
        monkeypatch.setattr(neardup, "BLOCK_BYTES", 4_000)
    texts = [t for _, t, *_ in corpus(60)]
    docs = [(4, texts[1]), (4, texts[2]), (9, texts[1]), (4, texts[1]), (None, texts[1]), (None, texts[12]), (None, texts[12]), (2, texts[13] + " and more"), (3, texts[13]), (8, None), (8, None), (5, ""), *[(20 + i, texts[14]) for i in range(40)], (1, texts[14] + " x")]
    docs = [(d, t, "en", "s", 1) for d, t in docs]
    df = frame(spark, docs).coalesce(1).selectExpr("*", "1 AS gone_id", "2 AS rid", "3 AS v", "4 AS first")
    out = neardup.filter_documents(df)
    assert out.columns == df.columns
    want = Counter([(4, texts[1]), (4, texts[2]), (None, texts[12]), (2, texts[13] + " and more"), (8, None), (8, None), (5, ""), (1, texts[14] + " x")])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    ids = Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert ids[(9, 4)] == 1 and ids[(None, 4)] == 1 and ids[(None, None)] == 2 and ids[(3, 2)] == 1 and ids[(21, 1)] == 1


def test_near_duplicates_of_thousands(spark):
    """Recall over documents at many similarities, against all pairs found by an index of shingles."""
    rnd = random.Random(12)
    docs = []
    for i in range(500):
        base = [f"w{rnd.randrange(10**5)}" for _ in range(rnd.randint(40, 160))]
        for k in range(rnd.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 20))):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
            docs.append((len(docs), " ".join(w), "en", "s", 1))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t, *_ in docs}
    met = {}
    for d, s in sets.items():
        for g in s:
            met.setdefault(g, []).append(d)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(x, y) for m in met.values() for x in m for y in m if x < y}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    wrong = [d for d in sets if got[d] != top(d)]
    assert len(docs) > 1_500 and len(wrong) <= 0.002 * len(docs)


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}
