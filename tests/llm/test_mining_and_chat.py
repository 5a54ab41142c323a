"""Hard negatives, importance draw and chat formatting against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, importance, negatives, queries

from .helpers import DOCS, ascii_lower, corpus

# ---------------------------------------------------------------------------- hard negatives


def brute_negatives(rows, k=5):
    sound = sorted({(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    one = {}
    for i, label, v in sound:
        one.setdefault(i, (label, v))
    out = set()
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    for a, (label, q) in one.items():
        if a % 100:
            continue
        scores = sorted((-dot(q, v), i, other) for i, (other, v) in one.items() if i != a and len(v) == len(q))
        for p, i, _ in [s for s in scores if s[2] == label][:k]:
            found = [s for s in scores if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out |= {(a, i, rank, n, -p, -s) for rank, (s, n, _) in enumerate(found, 1)}
    return out


def mined(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return {tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, label, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


VECTORS = "vec_id long, embedding array<double>, label int, score int, list int, vector string"


@pytest.mark.parametrize("small", [True, False])
def test_negatives(spark, monkeypatch, small):
    """Clusters, ties, one vector in a third of all rows, repeated ids, nulls, other lengths; many small lists, tiles and blocks."""
    if small:
        for name, value in {"LIST_ROWS": 20, "TILE": 16, "AUDIENCE": 2, "FIRST": 2, "GROWTH": 2, "SAMPLE_ROWS": 100}.items():
            monkeypatch.setattr(negatives, name, value)
    rnd = np.random.default_rng(1)
    centers = rnd.normal(size=(12, 6)) * 3
    rows = [(i, i % 10, [float(x) for x in centers[i % 12] + rnd.normal(size=6) * 0.2]) for i in range(600)]
    rows += [(1000 + i, i % 3, [float(x) for x in centers[0]]) for i in range(300)]
    rows += [(100, 4, [1.0] * 6), (1100, 1, [0.0] * 6), (1100, 1, [0.0] * 6), (1200, 2, [-5.0] * 6)]
    rows += [(2000, None, [1.0] * 6), (2100, 1, None), (2200, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2300, 1, [float("inf")] * 6), (2400, 1, []), (None, 1, [1.0] * 6)]
    rows += [(2500, 1, [2.0, 3.0]), (2501, 1, [2.0, 2.5]), (2502, 3, [2.0, 2.9]), (2600, 1, [1e10] * 3), (2601, 1, [1e10] * 3), (2602, 2, [1e10] * 3)]
    df = spark.createDataFrame([(i, v, label, 1, 2, "x") for i, label, v in rows], VECTORS)
    shifted = [(i, None if label is None else (label + 1) % 10 if i is not None and i % 7 == 0 else label, v) for i, label, v in rows]
    want = brute_negatives(shifted)
    assert len(want) > 100 and mined(df) == want


def test_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == set()
    assert mined(spark.createDataFrame([(100, [1.0], 1, 1, 1, "x")], VECTORS)) == set()


def test_far_lists_are_not_visited(spark, monkeypatch):
    """With tight clusters a query meets its own list and few others."""
    monkeypatch.setattr(negatives, "LIST_ROWS", 50)
    monkeypatch.setattr(negatives, "FIRST", 2)
    rnd = np.random.default_rng(4)
    centers = np.eye(16) * 50
    rows = [(i, (i // 16) % 2, [float(x) for x in centers[i % 16] + rnd.normal(size=16) * 0.01]) for i in range(1600)]
    label = F.col("label")
    lists, index = negatives.build(negatives.sound_rows(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), label, 256, "vec_id", "embedding"))
    number = lambda x: F.lit(x).cast("long")
    window = F.struct(number(0).alias("tag"), number(negatives.LEAST).alias("low"), number(negatives.MOST).alias("high"), number(negatives.LEAST).alias("kth"))
    asking = lists.filter("vec_id = 100").select(F.col("vec_id").alias("anchor_id"), "label", "vector", F.array(window).alias("windows"))
    first = negatives.search(lists, index, asking, 5, True)
    full = first.filter("rank = 5").select("anchor_id", "tag", F.col("score").alias("found"))
    lists_of = len(index.value.radii)
    left = negatives.visits(negatives.raised(asking, full), index, 0, lists_of).count()
    assert lists_of >= 16 and left < lists_of / 2


# ---------------------------------------------------------------------------- importance draw

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(ascii_lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_draw(docs, target):
    per = [(d, *features(t)) for d, t in docs]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for *_, f in per:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    rows = []
    for d, n, f in per:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    eligible = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for rank, r in enumerate(eligible[: 5 * len(eligible) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def rank_free(rows):
    return sorted((str(x) for x in rows))


def test_op12(spark, tmp_path):
    docs = [*corpus(n=400), (None, "a null id and " + "many words " * 20, "en", "s", 1), (901, "A" * 20_000 + " tail", "en", "s", 1), (902, "é ß 日本 x1-y2_z\x00q " * 9, "en", "s", 1)]
    spark.createDataFrame(docs, DOCS).select("*", F.lit(1).alias("score"), F.lit(2).alias("rid"), F.lit(3).alias("buckets")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    target = ["the House stands near water", None, "", "der hund läuft über die straße"]
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in queries.QUERIES["op12_importance_draw"](spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = brute_draw([(d, t) for d, t, *_ in docs], target)
    assert rank_free(got) == rank_free(want) and sum(r[4] is not None for r in got) > 10


def test_draw_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in importance.resample(docs, none).select("doc_id", "n_features", "rank").collect())
    assert got == [(1, 3, None), (2, 0, None)]


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(importance, "PART", 40)
    counter, rnd = importance.Counter(), random.Random(2)
    for _ in range(150):
        text = "".join(rnd.choice("abAé 9.\n ") for _ in range(rnd.randint(0, 300)))
        n, f, buckets, counts = counter.long(text)
        want_n, want = features(text)
        assert (n, f) == (want_n, len(want)) and dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == {b: want.count(b) for b in want}


# ---------------------------------------------------------------------------- chat formatting

TURNS = "conv_id long, turn long, role string, text string, block int, example int, t string"


def conversations():
    rnd = random.Random(5)
    odd = ["", "[INST]", "</s>", "[\\INST] [\\\\/INST]", "<s>[", "a [/TURN] b", "[ROLE]x[/ROLE]", "\\", "$1 \\1", "line\nbreak é 日本", "<", "[SYS"]
    rows = []
    for c in range(40):
        for turn in range(rnd.randint(1, 9)):
            rows.append((c, turn, rnd.choice(["user", "assistant", "system", "tool", "[/ROLE]", None]), rnd.choice([*odd, None]) if rnd.random() < 0.6 else rnd.choice(odd) + rnd.choice(odd)))
    rows += [(50, i, "user" if i % 2 == 0 else "assistant", f"turn {i} </s>") for i in range(400)]  # a third of all rows
    rows += [(51, None, "user", "no number"), (51, 3, "assistant", "same"), (51, 3, "assistant", "same"), (51, 3, "assistant", "an other"), (None, 0, "user", "null id"), (None, 1, "assistant", "x" * 50_000)]
    rows += [(52, 0, "user", "never answered")]
    return rows


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        out[c] = (len(mine), digest("".join(f"{r}\n{x}\n" for _, r, x in mine)), len(loss), digest(loss))
    return out


def test_op13(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*r, 1, 2, "z") for r in rows], TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.QUERIES["op13_prefix_targets"](spark, str(tmp_path)).collect()}
    want = brute_chat([*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert got[-7].formatted_chars == len(r"[INST]<\/s>[\INST] ok [\/INST][/INST]<s><\/s>[\INST] ok [\/INST]</s>")


def test_examples(spark):
    """Each reply is an example of its own with all turns before it, and only it is under the loss."""
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in conversations()], TURNS)
    got = chat.examples(df).collect()
    of = lambda c: sorted((r for r in got if r.conv_id == c), key=lambda r: (r.block, r.example))
    for c in range(40):
        mine = sorted(((t, r or "", x or "") for i, t, r, x in conversations() if i == c))
        replies = [i for i, (_, r, _) in enumerate(mine) if r == "assistant"]
        wanted = replies + [len(mine) - 1] * (not replies or replies[-1] != len(mine) - 1)
        assert [r.context_turns for r in of(c)] == wanted
        whole = of(c)[-1].text
        assert all(whole.startswith(r.text) for r in of(c)) and [r.closes for r in of(c)] == [False] * (len(wanted) - 1) + [True]
        for r, i in zip(of(c), wanted, strict=True):
            assert (r.loss_from is None) == (mine[i][1] != "assistant")
            if r.loss_from is not None:
                back = re.sub(chat.ESCAPED, r"\1\2\3", r.text[r.loss_from : r.loss_to])
                assert back == mine[i][2] and r.text[r.loss_to :] == "</s>"
    long = of(50)
    assert len({r.block for r in long}) == 7 and sum(r.loss_from is not None for r in long) == 200
    assert max(len(r.text) for r in long) < 64 * 40


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.examples(none).count() == 0 and chat.digest(chat.examples(none)).count() == 0
