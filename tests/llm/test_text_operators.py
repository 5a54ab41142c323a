import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import common, idstore, langid, linedup, lm, packing, pieces, quality, wordtok

from .helpers import DOCS, ascii_lower, corpus, empty, frame, words


def ids_of(text, end):
    from tokenizers import Tokenizer

    global _tok
    try:
        _tok
    except NameError:
        _tok = Tokenizer.from_file(wordtok.default_vocabulary())
    return np.array([*_tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_word_encoder_equals_library():
    odd = ["", "  ", "Don't we'll 'S '' 12ab3 x's", "H̱ Á é", "a b c", "<|endoftext|> <|ENDOFTEXT|>a", "ΑΣ İI", "日本語 テスト", "a\x85b\x1cc", "µ ª ß × ÷", "👍🏽ok", "a" * 5000, None]
    offsets, ids = wordtok.encoder(wordtok.default_vocabulary()).encode(pa.array(odd))
    for k, t in enumerate(odd):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(t, 2)[:-1].tolist(), t


def test_pieces_equal_library_and_decode():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_vocabulary())
    rnd = random.Random(1)
    texts = ["", "  a  b", "é́ 日本", "a\tb\nc", "\n\nab \n c ", "   ", "\n", "a" * 3000, "internationalization" * 60, None]
    texts += ["".join(rnd.choice("aeinst xyz.\n") for _ in range(rnd.randint(0, 400))) for _ in range(200)]
    codec = pieces.codec(pieces.default_vocabulary())
    offsets, ids = codec.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == model.encode(t or "")
    assert codec.decode(offsets, ids) == [t or "" for t in texts]


def test_unigram_paths_are_best():
    class Small(pieces.Pieces):
        def __init__(self):
            self.merges, self.unknown_score, self.longest = False, -20.0, 3
            self.score = {"a": -2.0, "b": -2.5, "ab": -3.0, "bab": -4.0, "ba": -3.5}

    v = pieces.Viterbi(Small(), every=8)
    rnd = random.Random(2)
    for _ in range(50):
        t = "".join(rnd.choice("abc") for _ in range(60))
        best = [0.0] + [-1e9] * len(t)
        for i in range(1, len(t) + 1):
            for n in range(1, min(3, i) + 1):
                s = t[i - n : i]
                best[i] = max(best[i], best[i - n] + v.p.score.get(s, -20.0 if n == 1 else -1e9))
        got = list(v.stream(t))
        assert "".join(got) == t and abs(sum(v.p.score.get(s, -20.0) for s in got) - best[-1]) < 1e-9


def test_quality_counts(spark):
    rows = corpus()
    got = quality.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, text, *_ in rows:
        w = words(text)
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = by[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.base_failed or not r.kept)
    kept = {r.doc_id for r in got if r.kept}
    out = quality.filter_documents(frame(spark, rows))
    assert {r.doc_id for r in out.collect()} == kept and out.columns == frame(spark, rows).columns
    assert quality.score(empty(spark)).count() == 0


def test_bad_host_goes(spark):
    bad = [(i, "### " * 80, "en", "bad", 1) for i in range(40)] + [(100 + i, corpus()[20 + i][1], "en", f"h{i % 5}", 1) for i in range(20)] + [(99, corpus()[45][1], "en", "bad", 1)]
    hosts = {r.host: r.host_rejected for r in quality.hosts(quality.judge(quality.features(frame(spark, bad).drop("host")))).collect()}
    assert hosts["bad"] and not hosts["h1"]


def brute_edit(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rnd = random.Random(edits)
    pairs = set()
    for _ in range(300):
        a = "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            b.insert(rnd.randint(0, len(b)), rnd.choice("abc")) if rnd.random() < 0.5 or not b else b.pop(rnd.randrange(len(b)))
        pairs.add((a, "".join(b)))
    got = {(r.x, r.y) for r in linedup.verified(spark.createDataFrame(sorted(pairs), "x string, y string"), edits).collect()}
    assert got == {p for p in pairs if brute_edit(*p) <= edits}


BLANKS = " \t\r\f\v"


def line_rule(docs):
    """Every line's (class place, links, stays) by comparing all pairs; places are (doc_id or -1, number of the row, line)."""
    each = [((-1 if d is None else d, k, n), x.strip(BLANKS)) for k, (d, t, *_) in enumerate(docs) if t is not None for n, x in enumerate(t.split("\n")) if x.strip(BLANKS)]
    first = {}
    for place, f in sorted(each):
        first.setdefault(f, place)
    near = {f: [g for g in first if g != f and abs(len(f) - len(g)) <= 2 and brute_edit(f, g) <= min(2, max(len(f), len(g)) // 16)] for f in first}
    return {p: (first[f], len(near[f]), p == first[f] and all(first[f] < first[g] for g in near[f])) for p, f in each}


def line_corpus(seed=4):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(2, 60))).strip() + "z" for _ in range(25)]
    docs = []
    for i in range(30):
        ls = []
        for _ in range(5):
            x = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(x))
                x[k : k + rnd.choice([0, 1, 1])] = rnd.choice(["", "a", "g"])
                x = x or ["q"]
            ls.append(rnd.choice(["", " "]) + "".join(x))
        docs.append((i, "\n".join([*ls, "the same short line", ""]), "en", "s", 1))
    docs += [(50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "x" * 5_000, "en", "s", 0), (53, "x" * 4_999 + "y", "en", "s", 0)]
    docs += [(7, "a line that no other row of all these holds\nand" + "\n".join(base[:2]), "en", "s", 1), (7, docs[3][1] + "\nsomething quite of its own, too", "en", "s", 1), (None, base[3] + "\n" + docs[7][1], "en", "s", 1), (None, "nothing like it anywhere, not at all", "en", "s", 1)]
    return docs


@pytest.mark.parametrize("hot", [False, True])
def test_line_classes(spark, monkeypatch, tmp_path, hot):
    if hot:
        monkeypatch.setattr(common, "HOT_PARTS", 40)
        monkeypatch.setattr(linedup, "HOT_SEGMENT", 3)
    docs = line_corpus()
    want = line_rule(docs)
    df = frame(spark, docs).coalesce(1)  # rows are numbered in their order
    got = linedup.classes(common.row_ids(df).select("doc_id", "rid", "text")).collect()
    numbers = {r: k for k, r in enumerate(x.rid for x in common.row_ids(df).select("rid").collect())}
    place = lambda s: (-1 if s.doc_id is None else s.doc_id, numbers[s.rid], s.line_no)
    assert {place(r): (place(r.first), r.n_links, r.kept) for r in got} == want and len(got) == len(want)
    public = linedup.line_classes(df).collect()
    assert sum(r.kept for r in public) == sum(w[2] for w in want.values()) and len(public) == len(want)
    assert linedup.line_classes(empty(spark)).count() == 0


@pytest.mark.parametrize("files", [False, True])
def test_lines_go_by_row(spark, tmp_path, files):
    """Rows of one id lose their own lines only, and no column's name does harm."""
    docs = line_corpus(5)
    stays = {p for p, w in line_rule(docs).items() if w[2]}
    want = []
    for k, (d, t, *_) in enumerate(docs):
        if t is not None:
            ls = [(x, (-1 if d is None else d, k, n)) for n, x in enumerate(t.split("\n"))]
            left = [x for x, p in ls if p in stays or not x.strip(BLANKS)]
            t = t if len(left) == len(ls) else "\n".join(left)
            if len(left) < len(ls) and not t.strip(BLANKS + "\n"):
                continue
        want.append((-1 if d is None else d, t))
    df = frame(spark, docs).coalesce(1).selectExpr("*", "1 AS gone", "2 AS gone_id", "3 AS rid", "4 AS line_no", "5 AS first", "6 AS n")
    if files:
        df.write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    out = linedup.filter_documents(df)
    assert out.columns == df.columns
    show = lambda rows: sorted(rows, key=str)
    got = out.collect()
    if files:  # which of two rows of one id is the first depends on the files; as many lines stay
        assert len(got) == len(want) and {r.doc_id for r in got} == {None if d < 0 else d for d, _ in want}
    else:
        assert show((-1 if r.doc_id is None else r.doc_id, r.text) for r in got) == show(want)


def test_letter_f_is_no_blank(spark):
    docs = [(1, "fan\nan\nlea\nleaf\nfff\nfff", "en", "s", 1), (2, "\f an \f\n\f\nother", "en", "s", 1)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.kept) for r in linedup.line_classes(frame(spark, docs)).collect()}
    own = {(1, n): (1, n, True) for n in range(5)}
    assert got == {**own, (1, 5): (1, 4, False), (2, 0): (1, 1, False), (2, 2): (2, 2, True)}
    assert {r.doc_id: r.text for r in linedup.filter_documents(frame(spark, docs)).collect()} == {1: "fan\nan\nlea\nleaf\nfff", 2: "\f\nother"}


def check_pieces(rows, docs, length, end):
    for d, text, *_ in docs:
        want = ids_of(text, end)
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: (r.start, r.sequence_id))
        assert sum(r.length for r in mine) % len(want) == 0
        for r in mine:
            assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill[r.sequence_id] == r.offset
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= length
    return fill


def test_packing(spark):
    docs = corpus()
    fill = check_pieces(packing.pack(frame(spark, docs).coalesce(1), length=1024, block=5000).collect(), docs, 1024, 2)
    assert sum(fill.values()) > 0.9 * 1024 * len(fill)
    assert packing.pack(empty(spark)).count() == 0


def test_cuts_are_optimal():
    rnd = random.Random(3)
    for _ in range(60):
        position = np.cumsum([0, *(rnd.randint(1, 6) for _ in range(25))])
        penalty = np.array([0, *(rnd.choice([0, 2, 9]) for _ in range(25))])
        best = [0] + [10**9] * 25
        for j in range(1, 26):
            best[j] = min(best[i] + 10 - (position[j] - position[i]) + penalty[j] for i in range(j) if position[j] - position[i] <= 10)
        chosen = packing.cuts(position, penalty, 10)
        ends = [0, *chosen]
        cost = sum(10 - (position[b] - position[a]) + penalty[b] for a, b in zip(ends, ends[1:], strict=False))
        assert chosen[-1] == 25 and cost == best[25]


@pytest.mark.parametrize("block", [4096, 2])
def test_id_store(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(idstore, "SHARDS_OF_BLOCK", block)
    docs = [*corpus(), *[(3, f"other words {i}", "en", "s", 1) for i in range(30)], (None, "no id", "en", "s", 1), (None, None, "en", "s", 1)]
    table = idstore.write(frame(spark, docs), f"file://{tmp_path}/ids", 5)
    manifest = table.orderBy("shard").collect()
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in idstore.read(spark, table).collect()), key=lambda r: r[1])
    at, want = 0, []
    crc = lambda t: -1 if t is None else zlib.crc32(t.encode())
    for d, text, *_ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, crc(r[1]))):
        x = ids_of(text, 1)
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    opened = [idstore.Shard(m.uri) for m in manifest]
    assert sum(len(s.get(3)) for s in opened) == 32 and opened[-1].get(int(manifest[-1].last_id))[0][-1] == 1
    assert sum(len(opened[0].get(k)) for k in range(10**6, 10**6 + 200)) == 0
    assert [x for s in opened for a, b, raw in s.runs(64) for x in raw.tolist()] == [i for d, text, *_ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, crc(r[1]))) for i in ids_of(text, 1).tolist()]
    assert idstore.read(spark, idstore.write(empty(spark), f"file://{tmp_path}/none", 2)).count() == 0


def test_ids_beyond_the_width_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="fit the width"):
        idstore.write(frame(spark, corpus()), f"file://{tmp_path}/ids", 1, width=1)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    shift, slot = idstore.build(keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    a, base, step, _ = idstore.hashes(keys)
    assert (idstore.slots(base, step, shift[(a % np.uint64(len(shift))).astype(np.int64)], len(keys)) == slot).all()


def test_language(spark):
    docs = corpus(240)
    df = frame(spark, docs)
    model = langid.train(df, langid.trainable())
    out = {r.doc_id: r for r in langid.predict(df, model).select("row.doc_id", "lang_pred", "score").collect()}
    sound = [r for r in docs if len(words(r[1])) > 20 and r[2]]
    assert sum(out[r[0]].lang_pred == r[2] for r in sound) >= 0.97 * len(sound)
    assert all(out[d].lang_pred == "und" and out[d].score == 0 for d in (5, 6, 7, 8))
    assert all(0 <= r.score <= 1 for r in out.values())
    relabelled = [(d, t, "en" if zlib.crc32(str(d).encode()) % 4 == 2 else x, s, n) for d, t, x, s, n in docs]
    again = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.train(frame(spark, relabelled), langid.trainable())).select("row.doc_id", "lang_pred").collect()}
    assert again == {d: r.lang_pred for d, r in out.items()}
    assert langid.filter_documents(empty(spark)).count() == 0


def test_windows_give_the_same_counts(monkeypatch):
    text = "abc déf " * 300
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "WINDOW", 128)
    part = langid.counts(text)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all() and whole[2] == part[2]


@pytest.mark.parametrize("head", [lm.HEAD, 5])
def test_lm_scores(spark, monkeypatch, head):
    """Counts, base and score of every text against plain Python, from the trained vectors."""
    seen = {}
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (head,))
    monkeypatch.setattr(lm, "PASSES", 4)
    before, train = lm.vocabulary, lm.train
    monkeypatch.setattr(lm, "vocabulary", lambda *a: seen.setdefault("vocab", before(*a)))
    monkeypatch.setattr(lm, "train", lambda *a: seen.setdefault("model", train(*a)))
    docs = [*corpus(), (None, "a row without an id", "en", "s", 1)]
    tokens = [(d, [*words(ascii_lower(t)), None]) for d, t, *_ in docs]
    out = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in tokens}
    c = Counter(w for d, t in tokens if not out[d] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.score(frame(spark, docs)).collect()}
    vocab, m = seen["vocab"][0], seen["model"]
    size = m.context.shape[1]
    own = {w for w, u in zip(vocab.head, vocab.units, strict=True) if u not in set(vocab.clusters)}
    assert len(own) == min(head, sum(k > 1 and w is not None for w, k in c.items()))
    inside = {k: [x for w, x in c.items() if w is not None and w not in own and lm.cluster(w) == k] for k in range(lm.CLUSTERS)}

    def unit(w):
        return vocab.end if w is None else int(vocab.units[vocab.head[w]]) if w in own else int(vocab.clusters[lm.cluster(w)])

    def log_p(past, u):
        q = sum(m.context[x].astype(float) @ m.mixing[j].reshape(size, size).astype(float) for j, x in enumerate(past))
        score = lambda row: float(row[:size].astype(float) @ q + row[size])
        softmax = lambda rows, k: score(rows[k]) - np.log(sum(np.exp(score(r)) for r in rows))
        g = int(m.group_of[u])
        return softmax(m.group, g) + softmax(m.target[m.starts[g] : m.starts[g + 1]], u - int(m.starts[g]))

    for d, t in tokens:
        r = got[d]
        want = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.score < 0
        if d in (None, 5, 6, 9, 12, 20, 33):
            units, model = [unit(w) for w in t], 0.0
            for i, w in enumerate(t):
                past = [units[i - j] if i >= j else vocab.end for j in range(1, lm.BACK + 1)]
                share = 0.0 if w is None or w in own else np.log10((c[w] + 1) / (sum(inside[lm.cluster(w)]) + len(inside[lm.cluster(w)]) + 1))
                model += log_p(past, units[i]) / np.log(10) + share
            assert abs(r.score - model) < 1e-4 * abs(model)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert lm.score(empty(spark)).count() == 0


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    follow = rng.permutation(40)
    flat = [0]
    for _ in range(30_000):
        flat.append(int(follow[flat[-1]]) if rng.random() < 0.8 else int(rng.integers(40)))
    flat = np.array(flat, np.uint16)
    m = lm.LogBilinear(np.bincount(flat, minlength=40), size=8, back=2)
    lm.Trainer(m, few=4).stream([(flat, np.array([len(flat)]))], 0, batch=256)
    past = np.tile(rng.integers(0, 40, (2, 7)), 40)
    p = 10 ** m.log_probs(past, np.repeat(np.arange(40), 7))
    assert np.allclose(p.reshape(40, 7).sum(axis=0), 1, atol=1e-4)
    share = np.bincount(flat, minlength=40) / len(flat)
    assert m.log_probs(lm.before(flat, np.array([len(flat)]), 0, 2), flat).mean() > np.log10(share[flat]).mean() + 0.4


def test_trainers_share_what_they_learned(spark, monkeypatch):
    """Several trainers and rounds give about the likelihood of one."""
    docs = corpus(120)
    whole = sum(r.score for r in lm.score(frame(spark, docs).repartition(4)).collect())
    monkeypatch.setattr(lm, "SHARE", 2_000)
    split = sum(r.score for r in lm.score(frame(spark, docs).repartition(4)).collect())
    assert abs(split - whole) < 0.1 * abs(whole)
    # sums in a tree of small groups are those of one group
    monkeypatch.setattr(lm, "FAN", 2)
    tree = sum(r.score for r in lm.score(frame(spark, docs).repartition(4)).collect())
    assert abs(tree - split) < 1e-3 * abs(split)


def test_op6(spark, tmp_path):
    """The registered query: counts and base scores against plain Python, scores of a proper distribution."""
    from plumbline.llm import queries

    docs = corpus(80)
    spark.createDataFrame(docs, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_log_bilinear"](spark, str(tmp_path)).collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*words(ascii_lower(t)), None]
    c = Counter(w for d, t, *_ in docs if not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((d, out(d), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(np.log10((c[w] + 1) / (n * 1.0 + v + 1)) for w in tokens(t)), 4)) for d, t, *_ in docs)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
