"""Near-duplicate documents by MinHash.

Texts are sets of distinct word shingles.  Documents with equal word sequences are one node.  Each
node gets ``HASHES`` minima of universal hashes; the minima in bands give bucket keys.

1. Every member of a bucket is paired with the bucket's least id.  Pairs whose signatures agree
   enough are confirmed on the full sets, one pair for each document, and tied into components.
2. Buckets that still hold more than one component are cut into blocks of bounded size; blocks meet
   in tiles, where signatures are compared.  The documents (not the pairs) that agree with one of
   another component meet in tiles again, now with their full sets, and only links that join two
   components come out.  Then components are made again.

So every pair that shares a bucket is either inside one component already or compared; no bucket is
capped, and none is a single task.  Blocks are bounded by rows and by the bytes of their sets.  Sets
are made only for documents in such pairs: a bit map that grows with them, up to a bound, marks them
for the second scan (strays do no harm).  A word sequence that fills more than a thousandth of all
rows is broadcast with its component, so that its copies aren't one task.

Defined results: texts without words are linked with nothing; with fewer words than a shingle the
whole sequence is one; every row is a document of its own, also where rows repeat an id: a component
is known by the least id in it; a row without an id takes part, and has no component id where no row
of its component has one; the filter keeps the first row of each component (by id, rows without an id
last, then in an order fixed by the files); an empty table gives an empty result; columns other than
id and text are not read, and the filter keeps them, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from .lm import split
from .pieces import slices

#: Minima and bands: a pair at similarity 0.75 shares no band with probability below 1e-5.
HASHES, BANDS, WORDS = 128, 32, 5
LEAST = 0.75
#: Signatures of a pair at LEAST agree in a smaller part than this with probability below 1e-4.
AGREE = LEAST - 4 * (LEAST * (1 - LEAST) / HASHES) ** 0.5
#: Rows and bytes of sets of a block; bits of the map of documents whose sets are made (its size follows their number).
BLOCK, BLOCK_BYTES = 2_048, 16_000_000
LEAST_BITS, MOST_BITS = 20, 28


def constants(n: int, seed: int) -> np.ndarray:
    return common.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[list[np.ndarray], list[bytes]]:
    """Shingle hashes of every text (with repeats), and a digest of its word sequence (empty without words)."""
    import xxhash

    bounds, words = split(texts)
    h = common.string_hashes(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    c = constants(WORDS, 17)
    rolling = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolling += h[k : k + len(rolling)] * c[k]
    rolling = common.mix64(rolling)
    out, digests = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(rolling[a : b - WORDS + 1])
        else:
            whole = np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), 5)], np.uint64)
            out.append(whole[: b > a])
        digests.append(xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else b"")
    return out, digests


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of every universal hash (multiply, add, keep the high half) over each set; sets aren't empty."""
    a, b = constants(HASHES, 101), constants(HASHES, 202)
    out = np.zeros((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 60_000):
            size += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        n = np.fromiter(map(len, sets[at:to]), np.int64, to - at)
        starts = np.cumsum(n) - n
        v = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, a[k], out=v)
            v += b[k]
            out[at:to, k] = np.minimum.reduceat(v, starts) >> np.uint64(32)
        at = to
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = HASHES // BANDS
    c = constants(rows, 303)
    keys = (sig.reshape(len(sig), BANDS, rows).astype(np.uint64) * c).sum(axis=2, dtype=np.uint64)
    return common.mix64(keys + constants(BANDS, 404)).view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, rid, digest (d1, d2; null without words), n_shingles, signature."""

    def go(batches):
        for batch in batches:
            at = 0
            for texts in slices(batch["text"], 2_000_000):
                sets, digests = shingles(texts)
                first: dict[bytes, int] = {}
                for i, d in enumerate(digests):
                    first.setdefault(d, i)
                first.pop(b"", None)
                once = list(first.values())
                sig = signatures([sets[i] for i in once]) if once else np.zeros((0, HASHES), np.uint32)
                row = {d: k for k, d in enumerate(first)}
                size = [len(np.unique(sets[i])) for i in once]
                mine = [row.get(d, -1) for d in digests]
                two = np.frombuffer(b"".join(d or bytes(16) for d in digests), "<i8").reshape(-1, 2)
                none = np.array([k < 0 for k in mine])
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"].slice(at, len(texts)),
                        "rid": batch["rid"].slice(at, len(texts)),
                        "d1": pa.array(two[:, 0], mask=none),
                        "d2": pa.array(two[:, 1], mask=none),
                        "n_shingles": pa.array([size[k] if k >= 0 else 0 for k in mine], pa.int64()),
                        "sig": pa.array([sig[k].tobytes() if k >= 0 else None for k in mine], pa.binary()),
                    }
                )
                at += len(texts)

    return docs.select("doc_id", "rid", "text").mapInArrow(go, "doc_id long, rid long, d1 long, d2 long, n_shingles long, sig binary")


def with_bands(nodes: DataFrame) -> DataFrame:
    """key and id, a row for each band of each node."""

    def go(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(np.frombuffer(b"".join(b["sig"].to_pylist()), "<u4").reshape(-1, HASHES))
                yield pa.record_batch({"id": b["id"], "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))})

    return nodes.select("id", "sig").mapInArrow(go, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures and sizes allow a similarity of LEAST."""

    def go(batches):
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t[c].to_pylist()), "<u4").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
                yield t.filter(pa.array((x == y).mean(axis=1) >= AGREE)).select(["a", "b"])

    side = lambda x: nodes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter((100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b")))
    return both.mapInArrow(go, "a long, b long")


def positions(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = common.mix64(ids.astype(np.int64).view(np.uint64))
    return [((h >> np.uint64(s)) & np.uint64((1 << bits) - 1)).astype(np.int64) for s in (0, 18, 36)]


def bit_map(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A map with three bits set for every id, put together by the executors, and the logarithm of its size: about 16 bits an id, within bounds."""
    size = min(max(LEAST_BITS, (16 * ids.count()).bit_length()), MOST_BITS)

    def go(batches):
        for b in batches:
            at = np.unique(np.concatenate(positions(b["id"].to_numpy(), size)))
            word, one = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.record_batch({"word": word, "bits": one.view(np.int64)})

    rows = ids.mapInArrow(go, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64), size


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and its shingle hashes, in order, for at least the documents in ``ids``; written to the shared folder."""
    marks = docs.sparkSession.sparkContext.broadcast(bit_map(ids))

    def sets(batches):
        for batch in batches:
            at = 0
            for texts in slices(batch["text"], 2_000_000):
                ids = batch["rid"].slice(at, len(texts)).to_numpy()
                hit = np.ones(len(ids), bool)
                marked, size = marks.value
                for p in positions(ids, size):
                    hit &= (marked[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
                at += len(texts)
                if hit.any():
                    found, _ = shingles(texts.filter(pa.array(hit)))
                    yield pa.record_batch({"id": ids[hit], "hashes": pa.array([np.unique(s).tobytes() for s in found], pa.binary())})

    return common.keep(docs.select("rid", "text").mapInArrow(sets, "id long, hashes binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= 75 * union."""

    def compare(batches):
        for t in batches:
            good = []
            for x, y in zip(t["set_a"].to_pylist(), t["set_b"].to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common_part = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * common_part >= 75 * (len(p) + len(q) - common_part))
            yield t.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    full = full_sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), docs)
    side = lambda x: full.select(F.col("id").alias(x), F.col("hashes").alias(f"set_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(compare, "a long, b long").distinct()


def dealt(members: DataFrame) -> DataFrame:
    """Members of buckets (key, m, size, id, component, ...) copied to the tiles of two blocks that they belong to, tile by tile.

    m and size are the rows and the bytes of the bucket.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return rows.drop("blocks", "other", "m", "size").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def each_tile(batches):
    """The tiles of a partition, one table at a time."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        k = [t[c].to_numpy() for c in ("key", "low", "high")]
        edges = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1).tolist()]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            yield t.slice(s, e - s)
        rest = t.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def strips(t: pa.Table):
    """For runs of rows of a tile's lower block: their numbers, the numbers of the upper block, and which pairs may link.

    A pair may link if its components differ and sizes and signatures allow a similarity of LEAST.
    """
    comp, n, block = (t[c].to_numpy() for c in ("component", "n_shingles", "block"))
    if (comp == comp[0]).all():
        return
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(-1, HASHES)
    left, right = np.flatnonzero(block == t["low"][0].as_py()), np.flatnonzero(block == t["high"][0].as_py())
    for at in range(0, len(left), 32):
        x = left[at : at + 32]
        far = comp[x][:, None] != comp[right][None]
        far &= 100 * np.minimum(n[x][:, None], n[right][None]) >= 75 * np.maximum(n[x][:, None], n[right][None])
        i, j = np.nonzero(far)
        far[i, j] = (sig[x[i]] == sig[right[j]]).mean(axis=1) >= AGREE
        some = far.any(axis=0)
        if some.any():
            yield x, right[some], far[:, some]


def involved(members: DataFrame) -> DataFrame:
    """key and id of the members that may link with one of another component: rows for members, none for pairs."""

    def go(batches):
        for t in each_tile(batches):
            hit = np.zeros(t.num_rows, bool)
            for x, right, far in strips(t):
                hit[x] |= far.any(axis=1)
                hit[right] |= far.any(axis=0)
            if hit.any():
                yield pa.record_batch({"key": t["key"].to_numpy()[hit], "id": t["id"].to_numpy()[hit]})

    return dealt(members).mapInArrow(go, "key long, id long").distinct()


def linked(members: DataFrame) -> DataFrame:
    """Links (a, b) between components, confirmed on the full sets inside the tiles.

    Once two components are joined in a tile, further links between them are left out there, so a
    tile gives fewer links than it has rows.
    """

    def one(t: pa.Table):
        ids, label = t["id"].to_numpy(), t["component"].to_numpy().copy()
        sets = [np.frombuffer(s, np.uint64) for s in t["hashes"].to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        present = np.zeros(len(flat) + 1, np.int64)
        for x, right, far in strips(t):
            span = np.concatenate([flat[starts[r] : starts[r] + size[r]] for r in right])
            at = np.cumsum(size[right]) - size[right]
            for k, row in enumerate(x.tolist()):
                if not far[k].any():
                    continue
                own = flat[starts[row] : starts[row] + size[row]]
                present[own] = 1
                shared = np.add.reduceat(present[span], at)
                present[own] = 0
                good = far[k] & (100 * shared >= 75 * (size[row] + size[right] - shared))
                for j in right[good].tolist():
                    if label[j] != label[row]:
                        label[label == label[j]] = label[row]
                        yield min(ids[row], ids[j]), max(ids[row], ids[j])

    def go(batches):
        for t in each_tile(batches):
            found = list(one(t))
            if found:
                yield pa.record_batch({"a": np.array([f[0] for f in found], np.int64), "b": np.array([f[1] for f in found], np.int64)})

    return dealt(members).mapInArrow(go, "a long, b long").distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """Every row of doc_id, rid, text with n_shingles and ``v``: the component's least id and its first row."""
    rows = common.keep(describe(docs), "minhash")
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    nodes = rows.filter("d1 is not null").groupBy("d1", "d2").agg(F.min("rid").alias("id"), F.count(F.lit(1)).alias("copies"), F.min(here).alias("place"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = common.keep(nodes, "nodes")
    bands = common.keep(with_bands(nodes), "bands")
    buckets = bands.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = common.keep(bands.join(buckets, "key"), "buckets")
    common.forget(bands)
    stars = agreeing(shared.filter("id <> a").select("a", F.col("id").alias("b")).distinct(), nodes)
    first = common.keep(stars.groupBy("b").agg(F.min("a").alias("a")), "pairs")
    links = common.keep(confirmed(first, docs), "links")
    found = components.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = shared.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    members = labelled.join(mixed, "key").join(nodes, "id").select("key", "m", (F.col("m") * (4 * HASHES)).alias("size"), "id", "component", "n_shingles", "sig")
    second = common.keep(involved(members), "involved")
    few = second.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    few = few.join(nodes.select("id", "n_shingles", "sig"), "id")
    counts = few.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(8 * F.col("n_shingles") + 4 * HASHES).alias("size"))
    few = few.join(counts, "key").join(full_sets(second.select("id").distinct(), docs), "id")
    more = linked(few.select("key", "m", "size", "id", "component", "n_shingles", "sig", "hashes"))
    whole = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    final = components.components(whole)
    labels = nodes.select("d1", "d2", "id", "copies", "place").join(final.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = labels.groupBy("component").agg(F.min("place").alias("head"))
    table = common.keep(labels.join(heads, "component").select("d1", "d2", "copies", F.struct(F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("first")).alias("v")), "groups")
    return common.split_join(rows.select("doc_id", "rid", "n_shingles", "d1", "d2"), table, ["d1", "d2"], ["rid"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id in reach) and kept (whether that is the row's own) of every row."""
    common.prepare(docs.sparkSession)
    out = grouped(common.row_ids(docs).select("doc_id", "rid", "text"))
    component = F.coalesce("v.component_id", "doc_id")
    kept = F.when(F.col("doc_id").isNull(), F.coalesce(F.col("v.first") == F.col("rid"), F.lit(True))).otherwise(F.col("doc_id") == component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The first row of each component, with the columns of ``docs``."""
    common.prepare(docs.sparkSession)
    rows = common.row_ids(docs)
    gone = grouped(rows.select("doc_id", "rid", "text")).filter(F.col("v.first") != F.col("rid")).select("rid")
    return common.restored(rows.join(gone, "rid", "left_anti"), docs)
