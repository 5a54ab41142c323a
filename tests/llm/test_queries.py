"""Every registered query that has no SQL, through its registered function, against plain Python."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import common, langid, pieces, queries

from .helpers import DOCS, ascii_lower, corpus, words
from .test_set_operators import brute
from .test_text_operators import check_pieces, ids_of, line_rule


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [*corpus(), (900, "a" * 30_000 + " tail", "en", "src1", 1)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, docs


def test_op3(spark, folder):
    path, docs = folder
    got = queries.QUERIES["op3_virtual_slots"](spark, path).collect()
    want = sorted((d, len((t or "").encode()) + (t is not None) * 0 + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    loads, places = {}, {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        assert (r.map_version, r.next_version) == (1, 2) and r.next_shard in (r.shard, 16)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in got) and any(r.next_shard == 16 for r in got)


def test_op2(spark, folder):
    import sentencepiece

    path, docs = folder
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_vocabulary())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = sorted((d, len(x), crc(x), zlib.crc32((t or "").encode()), True) for d, t, *_ in docs for x in [model.encode(t or "")])
    got = queries.QUERIES["op2_piece_codec"](spark, path).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32, r.text_crc32, r.round_trip) for r in got) == want
    rows = pieces.decode_frame(pieces.encode_frame(spark.read.parquet(f"{path}/documents.parquet"))).collect()
    assert sorted((r.doc_id, r.decoded) for r in rows) == sorted((d, t or "") for d, t, *_ in docs)
    assert pieces.round_trip(spark.createDataFrame([], DOCS)).count() == 0


def test_streams_hold_a_window_only():
    """Texts of tens of thousands of characters without a break: ids as the library's, what is held stays small."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_vocabulary())
    v = pieces.Viterbi(pieces.Pieces(pieces.default_vocabulary()))
    rng = np.random.default_rng(3)
    held = []
    meeting = v.meeting
    v.meeting = lambda back, base, i: held.append(len(back)) or meeting(back, base, i)
    for letters in ("etaoinshrdlu", "ab", "0123456789", "日本é"):
        text = "".join(rng.choice(list(letters), 20_000))
        ids = [i for p in v.stream(pieces.SPACE + text) for i in v.p.ids(p)]
        assert ids == model.encode(text)
    assert len(held) > 100 and np.median(held) < 400

    class Small(pieces.Pieces):
        def __init__(self):
            self.merges, self.unknown_score, self.longest = False, -20.0, 5
            self.score = {"a": -2.0, "b": -2.5, "ab": -3.0, "bab": -4.0, "ba": -3.5, "abbab": -6.1, "c": -1.0}

    u = pieces.Viterbi(Small())
    text = "".join(rng.choice(list("abc"), 30_000))
    best = [0.0] + [-1e18] * len(text)
    for i in range(1, len(text) + 1):
        for n in range(1, min(5, i) + 1):
            best[i] = max(best[i], best[i - n] + u.p.score.get(text[i - n : i], -1e18))
    got = list(u.stream(text))
    assert "".join(got) == text and abs(sum(u.p.score[s] for s in got) - best[-1]) < 1e-5


def test_op4(spark, folder):
    path, docs = folder
    rows = queries.QUERIES["op4_dp_packing"](spark, path).collect()
    fill = check_pieces(rows, docs, 4096, 2)
    assert sum(fill.values()) == sum(len(ids_of(t, 2)) for _, t, *_ in docs)


def test_op9(spark, folder):
    path, docs = folder
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op9_id_store"](spark, path).collect()))
    at, want = 0, []
    for d, t, *_ in sorted(docs, key=lambda r: r[0]):
        x = ids_of(t, 1)
        want.append((at, d, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want


def test_op10(spark, folder):
    """Predictions and probabilities from the trained weights, text by text."""
    path, docs = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    m = langid.train(df, langid.trainable(4, 2))
    got = {(r.doc_id, r.lang_pred, round(r.score, 5), r.held_out) for r in queries.QUERIES["op10_language"](spark, path).collect()}
    want = set()
    for d, t, *_ in docs:
        out = zlib.crc32(str(d).encode()) % 4 == 2
        if t is None or not any(c.isalpha() for c in t):
            want.add((d, "und", 0.0, out))
            continue
        at, n, total = langid.counts(t)
        z = (sum(c / max(total, 1) * m.weights[a].astype(float) for a, c in zip(at, n, strict=True)) + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want.add((d, m.languages[int(p.argmax())], round(float(p.max()), 5), out))
    near = lambda x: {(d, lang, out) for d, lang, _, out in x}
    assert near(got) == near(want)
    score = {d: s for d, _, s, _ in want}
    assert all(abs(s - score[d]) < 1e-3 for d, _, s, _ in got)


def test_every_label_is_learned(spark):
    """However few rows and bytes a label may have in the sample, it keeps one."""
    docs = [(i, f"word{i} and text", f"l{i % 30}" if i % 2 else "en", "s", 1) for i in range(400)]
    m = langid.train(spark.createDataFrame(docs, DOCS), langid.trainable(), columns=1)
    assert set(m.languages) == {d[2] for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2}


def test_fit_follows_the_regularised_leader():
    """Weights and temperature against a row-by-row update in plain Python."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        at = np.sort(rng.choice(60, 12, replace=False)) + (i % 3) * 20
        rows.append((f"l{i % 3}", at, rng.integers(1, 5, 12), 40))
    rows.sort(key=lambda r: (r[0], r[3], int(r[1].sum())))
    m = langid.fit(rows)
    alpha, beta, l1, l2, d = 0.5, 1.0, 0.05, 0.05, 1 << langid.BITS
    order = np.random.default_rng(7).permutation(len(rows)).tolist()
    checks, trains = order[::5], [i for j, i in enumerate(order) if j % 5]
    seen = [sum(c in rows[i][1] for i in trains) for c in range(100)]
    idf = [np.log((1 + len(trains)) / (1 + x)) + 1 for x in seen]
    z, n = {}, {}

    def weight(c, k):
        v = z.get((c, k), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + n[c, k] ** 0.5) / alpha + l2)

    def logits(row):
        x = {**{int(c): float(q) / row[3] * idf[c] * langid.SCALE for c, q in zip(row[1], row[2], strict=True)}, d: 1.0}
        return x, [sum(v * weight(c, k) for c, v in x.items()) for k in range(3)]

    for _ in range(4):
        for i in trains:
            x, out = logits(rows[i])
            top = max(out)
            p = [np.exp(o - top) / sum(np.exp(q - top) for q in out) for o in out]
            for k in range(3):
                for c, v in x.items():
                    g, w, old = v * (p[k] - (rows[i][0] == f"l{k}")), weight(c, k), n.get((c, k), 0.0)
                    n[c, k] = old + g * g
                    z[c, k] = z.get((c, k), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w
    assert m.languages == ["l0", "l1", "l2"] and np.allclose(m.bias, [weight(d, k) for k in range(3)])
    assert all(np.isclose(m.weights[c, k], weight(c, k) * idf[c] * langid.SCALE, rtol=1e-4, atol=1e-6) for c in range(100) for k in range(3))
    assert (m.weights[100:] == 0).all()

    def loss(t):
        nll = []
        for i in checks:
            out = [o / t for o in logits(rows[i])[1]]
            nll.append(np.log(sum(np.exp(o - max(out)) for o in out)) - (out[int(rows[i][0][1])] - max(out)))
        return sum(nll) / len(nll)

    assert loss(m.temperature) <= min(loss(t) for t in np.geomspace(0.2, 10, 60)) + 1e-9


def test_pipeline_stage_by_stage(spark, folder):
    """Each stage's rows from its predecessor's, by comparing all lines and all documents."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [[tuple(r) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.keep(stage(spark, docs, path).coalesce(1), f"test-{name}")
        seen.append([tuple(r) for r in docs.collect()] if name != "packing" else docs.collect())
    start, rules, language, lines, near, packed = seen
    assert {r[0] for r in rules} <= {r[0] for r in start if len(words(r[1])) >= 50}
    assert {r[0] for r in language} == {r[0] for r in rules}
    assert len({r[0] for r in language}) >= len(language) - 1  # one row is there twice
    stays = {}
    for (_, k, n), (_, _, kept) in line_rule(sorted(language, key=lambda r: r[0])).items():
        stays.setdefault(k, set()).update({n} if kept else set())
    texts = []
    for k, r in enumerate(sorted(language, key=lambda r: r[0])):
        left = [x for n, x in enumerate(r[1].split("\n")) if n in stays.get(k, ()) or not x.strip()]
        if any(x.strip() for x in left):
            texts.append((r[0], "\n".join(left)))
    assert sorted((r[0], r[1]) for r in lines) == sorted(texts)
    kept = brute([(r[0], ascii_lower(r[1])) for r in lines])
    assert sorted(r[0] for r in near) == sorted(d for d, (_, c) in kept.items() if d == c)
    check_pieces(packed, [(r[0], r[1]) for r in near], 4096, 2)
