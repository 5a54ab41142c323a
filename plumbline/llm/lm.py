"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Words are lower-cased (A to Z) runs of non-space; every text ends with an end token.

* Counts of all training words are a distributed table.  The most frequent words (a bounded number)
  are looked up in place; all others meet their counts in a join on the word.
* The model's units are the most frequent words (at most ``WORDS``), ``CLUSTERS`` classes of the rest
  by their ending, and the end token.  Inside a cluster a word has its add-one share.
* A context is the ``BACK`` units before a token.  Each position has a matrix of its own; the sum of
  the context vectors under these matrices predicts the token by products with its vector.
* Units lie in groups of about equal weight.  P(unit) = P(group | context) P(unit | group, context),
  both log-bilinear, so that a normalised probability takes a few hundred products, in batches.
* Training streams over all training tokens.  Trainers (their number grows with the tokens) begin a
  round with the same model, draw noise from unigrams, and step by adaptive gradients; a row's change
  is then averaged over trainers, weighted by how often each touched it.

Defined results: null and empty texts hold the end token alone; repeated rows are scored each; rows
without an id are learned from and scored; with no training text, all units are equally likely; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .pieces import slices

#: Words looked up in place, units of their own (bounds on what is broadcast), clusters of the rest.
HEAD, WORDS, CLUSTERS = 300_000, 32_768, 128
#: Units of context, size of vectors, training tokens of a trainer in a round, rounds (each over a part of the documents), passes.
BACK, SIZE, SHARE, ROUNDS, PASSES = 3, 16, 4_000_000, 3, 1
#: Trainers whose changes of a block of the model are added in one group.
FAN = 32


def cluster(word: str) -> int:
    return zlib.crc32(word.rstrip(".,;:!?\"')")[-3:].encode("utf-8", "surrogatepass")) % CLUSTERS


def split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Bounds of each text's words and the words themselves."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    before = np.concatenate([[0], np.cumsum(real)])
    return before[bounds - bounds[0]], words.filter(pa.array(real)).dictionary_encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c over all texts: counted in each slice, then added up."""

    def go(batches):
        for b in batches:
            for texts in slices(b["text"]):
                _, words = split(texts)
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)) if len(words) else np.zeros(0, np.int64)
                yield pa.record_batch({"word": words.dictionary.cast(pa.string()), "c": pa.array(n, pa.int64())})

    return docs.select("text").mapInArrow(go, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task needs to turn words into counts and units; bounded by HEAD and WORDS.

    Units are numbered by falling count; ``amounts`` are these counts.
    """

    head: dict[str, int]
    counts: np.ndarray
    units: np.ndarray
    clusters: np.ndarray
    end: int
    amounts: np.ndarray


def most_frequent(counts: DataFrame, head: int = HEAD) -> tuple[list[str], np.ndarray, int]:
    """The most frequent words with their counts, and the least count among them: words from there on are all in."""
    heights = sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(head + 1).collect()), reverse=True)
    least, total = heights[0][0] + 1 if heights else 1, 0
    for c, n in heights:
        if total + n > head:
            break
        least, total = c, total + n
    rows = counts.filter(F.col("c") >= least).toArrow()
    words, c = rows["word"].to_pylist(), rows["c"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    return [words[i] for i in order], np.array([c[i] for i in order], np.int64), least


def vocabulary(counts: DataFrame, ends: int, head: int = HEAD) -> tuple[Vocabulary, np.ndarray, int]:
    """Units; log10 of what a cluster's shares are divided by, for every unit; the least count in ``head``."""
    words, c, least = most_frequent(counts, head)
    own = {w for w, n in zip(words[:WORDS], c[:WORDS].tolist(), strict=True) if n > 1}

    def members(batches):
        for b in batches:
            at = np.array([cluster(w) if w not in own else CLUSTERS for w in b["word"].to_pylist()], np.int64)
            many = lambda **k: np.bincount(at, minlength=CLUSTERS + 1, **k)[:CLUSTERS].astype(np.int64)
            yield pa.record_batch({"k": np.arange(CLUSTERS), "c": many(weights=b["c"].to_numpy()), "v": many()})

    inside, kinds = np.zeros(CLUSTERS, np.int64), np.zeros(CLUSTERS, np.int64)
    for r in counts.mapInArrow(members, "k long, c long, v long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        inside[r.k], kinds[r.k] = r.c, r.v
    amounts = np.concatenate([c[: len(own)], inside, [ends]])
    order = np.argsort(-amounts, kind="stable")
    unit = np.empty(len(order), np.int64)
    unit[order] = np.arange(len(order))
    of_cluster = unit[len(own) : len(own) + CLUSTERS]
    units = np.array([unit[i] if i < len(own) else of_cluster[cluster(w)] for i, w in enumerate(words)], np.int64)
    shares = np.zeros(len(order))
    shares[of_cluster] = np.log10(inside + kinds + 1)
    return Vocabulary({w: i for i, w in enumerate(words)}, c, units, of_cluster, int(unit[-1]), amounts[order]), shares, least


SHAPE = "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, other_logs double, units binary, tail array<string>"


def read(docs: DataFrame, vocab: Vocabulary, ends: int) -> DataFrame:
    """Each document's units, the sums over its frequent words, and the words still to be looked up."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def go(batches):
        v = shared.value
        log_c = np.log10(v.counts + 1.0)
        clustered = np.zeros(len(v.amounts), bool)
        clustered[v.clusters] = True
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            at = 0
            for texts in slices(b["text"]):
                bounds, words = split(texts)
                names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
                index = words.indices.to_numpy()
                place = np.fromiter((v.head.get(w, -1) for w in names), np.int64, len(names))
                kinds = np.fromiter((v.units[p] if p >= 0 else v.clusters[cluster(w)] for w, p in zip(names, place, strict=True)), np.uint16, len(names))
                logs = np.append(log_c, 0.0)[place] if len(v.counts) else np.zeros(len(names))
                n = np.diff(bounds)
                total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[bounds])
                kind = kinds[index]
                out = np.insert(kind, bounds[1:], v.end).astype("<u2")
                offsets = 2 * (bounds + np.arange(len(bounds)))
                tail = place[index] < 0
                tails = np.concatenate([[0], np.cumsum(tail)])[bounds]
                yield pa.record_batch(
                    {
                        "rid": pa.array(rid + np.arange(len(n))),
                        "doc_id": b["doc_id"].slice(at, len(n)),
                        "held_out": b["held_out"].slice(at, len(n)),
                        "n_tokens": pa.array(n + 1),
                        "known": pa.array(total((~tail).astype(float)).round().astype(np.int64) + (ends > 0)),
                        "logs": pa.array(total(logs[index]) + np.log10(ends + 1.0)),
                        "other_logs": pa.array(total(np.where(clustered[kind], logs[index], 0.0))),
                        "units": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())]),
                        "tail": pa.ListArray.from_arrays(pa.array(tails, pa.int32()), words.dictionary.take(pa.array(index[tail])).cast(pa.string())),
                    }
                )
                rid += len(n)
                at += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(go, SHAPE)


def before(flat: np.ndarray, n: np.ndarray, end: int, back: int) -> np.ndarray:
    """The ``back`` units before every token of texts that lie one after the other; a text begins after ends."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((back, len(flat)), end, flat.dtype)
    for j in range(1, back + 1):
        out[j - 1, j:] = flat[:-j] if j < len(flat) else flat[:0]
        out[j - 1, place < j] = end
    return out


def summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of ``index``, the sums of their rows, and how often each occurs."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    ordered = index[order]
    first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    return ordered[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0), np.diff(np.append(first, len(index)))


PARTS = ("context", "mixing", "group", "target")


class LogBilinear:
    """Scores are products of a context's vector (with a one behind it, for biases) with groups' and units' vectors."""

    def __init__(self, amounts: np.ndarray, size: int = SIZE, back: int = BACK, seed: int = 11):
        rng = np.random.default_rng(seed)
        u = len(amounts)
        weight = (amounts + 0.5) / (amounts + 0.5).sum()
        wanted = max(1, round(u**0.5))
        middle = np.cumsum(weight) - weight / 2
        label = np.minimum((middle * wanted).astype(np.int64), wanted - 1)
        _, self.group_of = np.unique(label, return_inverse=True)
        self.starts = np.append(np.flatnonzero(np.diff(self.group_of, prepend=-1)), u)
        self.group_share = np.add.reduceat(weight, self.starts[:-1])
        self.unit_share = weight / self.group_share[self.group_of]
        self.upto = np.cumsum(weight)
        self.group_log, self.unit_log = (np.log(x).astype(np.float32) for x in (self.group_share, self.unit_share))
        make = lambda *shape: rng.normal(0, 0.1, shape)
        self.context = make(u, size).astype(np.float32)
        self.mixing = np.stack([np.eye(size) / (j + 1) for j in range(back)]).reshape(back, size * size).astype(np.float32)
        self.group = np.hstack([make(len(self.group_share), size), self.group_log[:, None]]).astype(np.float32)
        self.target = np.hstack([make(u, size) * 0.1, self.unit_log[:, None]]).astype(np.float32)

    def queries(self, prev: np.ndarray) -> np.ndarray:
        """The vectors of contexts, with a one behind."""
        size = self.context.shape[1]
        q = np.ones((prev.shape[1], size + 1), np.float32)
        q[:, :size] = sum(self.context.take(p, axis=0) @ m.reshape(size, size) for p, m in zip(prev, self.mixing, strict=True))
        return q

    def log_probs(self, prev: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of units after their contexts, in matrix products by group."""

        def normal(scores, rows):
            if np.abs(scores).max(initial=0) > 60:  # else no exponential can leave the range
                scores -= scores.max(axis=1, keepdims=True)
            chosen = scores[np.arange(len(scores)), rows]
            return chosen - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))

        out = np.zeros(len(units))
        for at in range(0, len(units), 32_768):
            u = units[at : at + 32_768].astype(np.int64)
            g = self.group_of[u]
            order = np.argsort(g.astype(np.uint16), kind="stable")
            u, g = u[order], g[order]
            q = self.queries(prev[:, at : at + 32_768][:, order])
            part = np.empty(len(u))
            for k in range(0, len(u), 1_024):  # small enough for the caches
                part[k : k + 1_024] = normal(q[k : k + 1_024] @ self.group.T, g[k : k + 1_024])
            edges = np.searchsorted(g, np.arange(len(self.group) + 1)).tolist()
            for k in np.unique(g).tolist():
                s, e = int(self.starts[k]), int(self.starts[k + 1])
                if e - s > 1:
                    step = max(1, 200_000 // (e - s))
                    for a in range(edges[k], edges[k + 1], step):
                        b = min(a + step, edges[k + 1])
                        part[a:b] += normal(q[a:b] @ self.target[s:e].T, u[a:b] - s)
            out[at + order] = part / np.log(10)
        return out


class Trainer:
    """Noise-contrastive steps over batches, from a shared model; remembers how often every row was touched."""

    def __init__(self, model: LogBilinear, noise: int = 40, few: int = 1, rate: float = 0.15, seed: int = 5, steps: dict | None = None):
        self.m, self.noise, self.few, self.rate, self.rng = model, noise, few, rate, np.random.default_rng(seed)
        self.squares = {k: np.full(len(getattr(model, k)), 1e-6, np.float32) for k in PARTS} if steps is None else {k: v.copy() for k, v in steps.items()}
        self.touched = {k: np.zeros(len(getattr(model, k)), np.float64) for k in PARTS}

    def real(self, scores: np.ndarray, logs: np.ndarray, noise: int) -> np.ndarray:
        """How likely a unit of this score is real and not one of ``noise`` draws, whose log shares are given."""
        x = logs - scores
        x += np.float32(np.log(noise))
        np.minimum(x, np.float32(30), out=x)
        np.exp(x, out=x)
        x += 1
        return np.reciprocal(x, out=x)

    def move(self, name: str, rows: np.ndarray, gradient: np.ndarray, n: np.ndarray) -> None:
        sq = self.squares[name]
        sq[rows] += (gradient * gradient).mean(axis=1)
        getattr(self.m, name)[rows] += self.rate / np.sqrt(sq[rows])[:, None] * gradient
        self.touched[name][rows] += n

    def step(self, prev: np.ndarray, units: np.ndarray) -> None:
        m, rng = self.m, self.rng
        size, n = m.context.shape[1], len(units)
        units = units.astype(np.int64)
        q = m.queries(prev)
        # which group: noise drawn once for the batch
        g = m.group_of[units]
        drawn = rng.choice(len(m.group), self.noise, p=m.group_share)
        own, others = m.group.take(g, axis=0), m.group[drawn]
        right = 1 - self.real(np.einsum("nd,nd->n", q, own), m.group_log[g], self.noise)
        wrong = -self.real(q @ others.T, m.group_log[drawn], self.noise)
        dq = right[:, None] * own + wrong @ others
        moves = [("group", np.concatenate([g, drawn]), np.concatenate([right[:, None] * q, wrong.T @ q]))]
        # which unit of the group: noise drawn for every token
        several = np.flatnonzero(m.unit_share[units] < 1)
        if len(several):
            u, gu, qu = units[several], g[several], q.take(several, axis=0)
            high = m.upto[m.starts[1:] - 1]
            other = np.searchsorted(m.upto, high[gu] - rng.random((self.few, len(u))) * m.group_share[gu])
            other = np.clip(other, m.starts[gu], m.starts[gu + 1] - 1)
            rows, back = [u, *other], np.zeros_like(qu)
            for k, r in enumerate(rows):
                v = m.target.take(r, axis=0)
                y = self.real(np.einsum("nd,nd->n", qu, v), m.unit_log[r], self.few)
                y = (1 - y if k == 0 else -y)[:, None]
                back += y * v
                rows[k] = (r, y * qu)
            dq[several] += back
            moves.append(("target", np.concatenate([r for r, _ in rows]), np.concatenate([x for _, x in rows])))
        dq = dq[:, :size]
        change, moved = [], []
        for j in range(len(prev)):
            mix = m.mixing[j].reshape(size, size)
            change.append((m.context.take(prev[j], axis=0).T @ dq).ravel())
            moved.append(dq @ mix.T)
        moves.append(("context", prev.ravel(), np.concatenate(moved)))
        for name, index, rows in moves:
            self.move(name, *summed(index, rows))
        self.move("mixing", np.arange(len(prev)), np.stack(change), np.full(len(prev), n))

    def stream(self, pieces, end: int, batch: int = 2_048) -> None:
        """All tokens of (flat units, lengths of texts), in order."""
        for flat, n in pieces:
            prev = before(flat, n, end, len(self.m.mixing))
            for at in range(0, len(flat), batch):
                self.step(prev[:, at : at + batch], flat[at : at + batch])


def unit_runs(batches):
    """Flat units and texts' lengths of record batches."""
    for b in batches:
        if b.num_rows:
            raw = b["units"].to_pylist()
            yield np.frombuffer(b"".join(raw), "<u2"), np.fromiter((len(r) // 2 for r in raw), np.int64, len(raw))


def train(rows: DataFrame, vocab: Vocabulary, tokens: int) -> LogBilinear:
    """The model after all rounds over ``rows`` (rid, units)."""
    context = rows.sparkSession.sparkContext
    model = LogBilinear(vocab.amounts)
    steps = Trainer(model).squares
    block, end = 4_096, vocab.end

    def go(batches):
        mine, s = shared.value
        t = Trainer(mine, seed=TaskContext.get().partitionId() + 1, steps=s)
        old = {k: getattr(mine, k).copy() for k in PARTS}
        t.stream(unit_runs(batches), end)
        for name in PARTS:
            now = getattr(mine, name)
            for at in range(0, len(now), block):
                w = t.touched[name][at : at + block]
                if w.any():
                    delta = ((now[at : at + block] - old[name][at : at + block]) * w[:, None]).astype("<f4")
                    yield pa.record_batch({"part": [name], "at": [at], "trainer": [TaskContext.get().partitionId()], "w": [w.astype("<f8").tobytes()], "delta": [delta.tobytes()], "sq": [((t.squares[name] - s[name])[at : at + block]).astype("<f4").tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = lambda c, kind: sum(np.frombuffer(x, kind).astype(np.float64) for x in table[c].to_pylist())
        return pa.table({"part": table["part"][:1], "at": table["at"][:1], "trainer": [table["trainer"][0].as_py() // FAN], "w": [total("w", "<f8").tobytes()], "delta": [total("delta", "<f4").astype("<f4").tobytes()], "sq": [total("sq", "<f4").astype("<f4").tobytes()]}, schema=table.schema)

    shape = "part string, at long, trainer long, w binary, delta binary, sq binary"
    for r in range(ROUNDS * PASSES):
        shared = context.broadcast((model, steps))
        mine = rows.filter(F.pmod("rid", F.lit(ROUNDS)) == r % ROUNDS).select("units")
        trainers = max(1, -(-tokens // (ROUNDS * SHARE)))
        sums = mine.coalesce(trainers).mapInArrow(go, shape)
        # a tree of sums: a group holds a block of the model from FAN trainers at most, however many there are
        while trainers > 1:
            sums, trainers = sums.groupBy("part", "at", F.floor(F.col("trainer") / FAN)).applyInArrow(add, shape), -(-trainers // FAN)
        for row in sums.toArrow().to_pylist():  # one row a block of the model
            w = np.frombuffer(row["w"], "<f8")
            part = getattr(model, row["part"])[row["at"] : row["at"] + len(w)]
            part += np.frombuffer(row["delta"], "<f4").reshape(len(w), -1) / np.maximum(w, 1)[:, None].astype(np.float32)
            steps[row["part"]][row["at"] : row["at"] + len(w)] += np.frombuffer(row["sq"], "<f4")
        shared.unpersist()
    return model


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


KEPT = ("rid", "doc_id", "held_out", "n_tokens", "known", "logs", "other_logs")


def score(docs: DataFrame, out: Column | None = None) -> DataFrame:
    """Scores of every document under add-one unigrams and under the model, learned from those not held out."""
    spark = common.prepare(docs.sparkSession)
    rows = common.columns(docs, "doc_id", "text").withColumn("held_out", held_out() if out is None else out)
    learned = rows.filter(~F.col("held_out"))
    counts = common.keep(word_counts(learned), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learned.select("held_out").count()
    n, v = n + ends, v + (ends > 0)
    vocab, shares, least = vocabulary(counts, ends)
    texts = common.keep(read(rows, vocab, ends), "lm-texts")
    model = train(texts.filter(~F.col("held_out")), vocab, n)
    shared = spark.sparkContext.broadcast((model, shares))

    def add_up(batches):
        model, shares = shared.value
        for b in batches:
            for flat, n in unit_runs([b]):
                each = model.log_probs(before(flat, n, vocab_end, len(model.mixing)), flat) - shares[flat]
                lm = np.add.reduceat(each, np.cumsum(n) - n)
                yield pa.record_batch([b[c] for c in KEPT] + [pa.array(lm)], names=[*KEPT, "lm"])

    vocab_end = vocab.end
    scored = common.keep(texts.drop("tail").mapInArrow(add_up, "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, other_logs double, lm double"), "lm-scores")
    rare = texts.select("rid", F.explode("tail").alias("word")).join(counts.filter(F.col("c") < least), "word")
    found = rare.groupBy("rid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("tail_logs"))
    more, tail_logs = F.coalesce("more", F.lit(0)), F.coalesce("tail_logs", F.lit(0.0))
    return scored.join(found, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("lm") + F.col("other_logs") + tail_logs).alias("score"),
    )
