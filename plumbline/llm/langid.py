"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters, taken over lower-case letters with everything else as a space,
are hashed into a fixed number of columns.  The model is trained by the follow-the-regularised-
leader rule with elastic-net penalties, and its temperature is set on rows kept out of training.

The fit takes about ``per_language`` labelled rows of each language, fewer where their texts are long or
labels are many (see ``train``), picked by a hash of id and text; this is the only sample, and no label is left out.  Prediction covers every
whole text.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and all texts where
no labelled row exists; repeated rows are predicted alike; an empty table gives an empty result;
columns besides those named take no part and keep their values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15
WINDOW = 1 << 19
SCALE = 100.0
GAP = "\x00\x00\x00"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(u: np.ndarray) -> list[np.ndarray]:
    """Columns of the 1-, 2- and 3-grams that begin at each character but the last three."""
    n = len(u) - 3
    spread, low = np.uint32(2654435761), np.uint32(32 - BITS)
    one = u[:n] * np.uint32(0x9E3779B1)
    two = one ^ (u[1 : n + 1] * np.uint32(0x85EBCA6B) + np.uint32(0x27220A95))
    three = two ^ (u[2 : n + 2] * np.uint32(0xC2B2AE35) + np.uint32(0x165667B1))
    return [((h ^ (h >> np.uint32(15))) * spread) >> low for h in (one, two, three)]


def groups(texts: list[str]):
    """Runs of texts of about WINDOW characters: (first, last + 1)."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > WINDOW:
            yield at, k
            at, size = k, 0
        size += len(t) + 3
    if at < len(texts):
        yield at, len(texts)


def windows(texts: list[str]):
    """(text numbers' starts, first text, characters) of pieces; a text beyond WINDOW comes in pieces that overlap by an n-gram."""
    for a, b in groups(texts):
        if b - a == 1 and len(texts[a]) > WINDOW:
            t = texts[a]
            for k in range(0, len(t), WINDOW):
                yield a, np.zeros(1, np.int64), t[k : k + WINDOW + 3] if k + WINDOW < len(t) else t[k:] + GAP
        else:
            n = np.fromiter((len(t) + 3 for t in texts[a:b]), np.int64, b - a)
            yield a, np.cumsum(n) - n, GAP.join(texts[a:b]) + GAP


def characters(s: str) -> np.ndarray:
    return letters()[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]


def counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Columns, their counts, and the number of n-grams of a text."""
    total = np.zeros(1 << BITS, np.int64)
    for _, _, s in windows([text]):
        for g in grams(characters(s)):
            total += np.bincount(g, minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at], int(total.sum())


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # columns x languages, IDF and SCALE included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every text, and which have a letter."""
        k = len(self.languages)
        total, n, has = np.zeros((len(texts), k)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for first, starts, s in windows(texts):
            u = characters(s)
            m = len(u) - 3
            if m <= 0:
                continue
            own = slice(first, first + len(starts))
            has[own] |= np.add.reduceat((u[:m] != 32).astype(np.int64), np.minimum(starts, m - 1)) > 0
            found = grams(u)
            ends = np.append(starts[1:] - 3, m)
            gaps = (ends[:-1, None] + np.arange(3)).ravel()  # n-grams that begin there reach into the next text
            for j in range(k):
                w = self.weights[:, j]
                v = w[found[0]] + w[found[1]] + w[found[2]]
                v[gaps] = 0
                total[own, j] += np.add.reduceat(v, np.minimum(starts, m - 1), dtype=np.float64)
            n[own] += 3 * (ends - starts)
        return total / np.maximum(n, 1)[:, None] + self.bias, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        given = [t or "" for t in texts]
        if not self.languages:
            return ["und"] * len(given), np.zeros(len(given))
        z, has = self.logits(given)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, seed: int = 7) -> Model:
    """rows: language, columns, counts, number of n-grams.  Each fifth row sets the temperature."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    k, d = len(languages), 1 << BITS
    code = {x: i for i, x in enumerate(languages)}
    order = np.random.default_rng(seed).permutation(len(rows))
    checks, trains = (order[::5], [i for j, i in enumerate(order) if j % 5]) if len(rows) >= 20 else (order, order)
    df = np.zeros(d)
    for i in trains:
        df[rows[i][1]] += 1
    idf = np.log((1 + len(trains)) / (1 + df)) + 1
    x = lambda r: r[2] / max(r[3], 1) * idf[r[1]] * SCALE
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    for _ in range(epochs):
        for i in trains:
            r = rows[i]
            at, v = np.append(r[1], d), np.append(x(r), 1.0)
            w = weights(at)
            p = softmax((v @ w)[None])[0]
            p[code[r[0]]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(d + 1))
    model = Model(languages, (w[:d] * idf[:, None] * SCALE).astype(np.float32), w[d], 1.0)
    logits = np.stack([x(rows[i]) @ w[rows[i][1]] + w[d] for i in checks])
    truth = np.array([code[rows[i][0]] for i in checks])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    model.temperature = min(np.geomspace(0.2, 10, 60), key=loss)
    return model


def train(docs: DataFrame, trainable: Column, per_language: int = 600, columns: int = 24_000_000) -> Model:
    """Fit on a sample of the labelled rows that ``trainable`` marks, with every label among them.

    The sample is bounded in expectation: about ``per_language`` rows of each label, and about ``columns`` used
    columns (12 bytes each) over all labels, of which each label has an equal part; but each label keeps one row.
    """
    common.prepare(docs.sparkSession)
    rows = common.columns(docs, "doc_id", "text", "lang").filter(trainable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))), F.lit(1_000_003))
    used = F.least(3 * F.length("text"), F.lit(1 << BITS)).cast("long")  # of a text, at most
    have = common.keep(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(used).alias("used"), F.min(draw).alias("first")), "labels")
    labels = have.count()
    share = F.least(F.lit(per_language) / F.col("n"), F.lit(columns / max(labels, 1)) / F.greatest("used", F.lit(1)), F.lit(1.0))
    pick = have.select("lang", "first", share.alias("share"))
    sample = common.join_dimension(rows.withColumn("draw", draw), pick, "lang", "inner", labels)
    sample = sample.filter((F.col("draw") < F.col("share") * 1_000_003) | (F.col("draw") == F.col("first"))).select("lang", "text")

    def count(batches):
        for b in batches:
            got = [counts(t) for t in b["text"].to_pylist()]
            yield pa.record_batch({"lang": b["lang"], "at": pa.array([g[0] for g in got], pa.list_(pa.int32())), "n": pa.array([g[1] for g in got], pa.list_(pa.int64())), "total": pa.array([g[2] for g in got], pa.int64())})

    found = sample.mapInArrow(count, "lang string, at array<int>, n array<long>, total long").toArrow()
    rows = [(x, np.asarray(a), np.asarray(c), t) for x, a, c, t in zip(*(found[k].to_pylist() if k in ("lang", "total") else [v.values.to_numpy() for v in found[k]] for k in ("lang", "at", "n", "total")), strict=True)]
    return fit(sorted(rows, key=lambda r: (r[0], r[3], int(r[1].sum() if len(r[1]) else 0))))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """A struct ``row`` with all columns of ``docs``, and ``lang_pred`` and ``score`` beside it."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("input"))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def go(batches):
        m = shared.value
        for b in batches:
            lang, score = m.predict(b["input"].to_pylist())
            yield pa.record_batch({"row": b["row"], "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return rows.mapInArrow(go, schema)


def trainable(modulus: int = 4, out: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) != out


def filter_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language is known with probability of at least ``least``; those without letters go."""
    model = train(docs, F.lit(True))
    kept = predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
