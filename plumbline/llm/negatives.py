"""Hard negatives by inverted lists of k-means clusters, visited in order of Cauchy-Schwarz bounds.

Centroids are fitted on a bounded sample; every row is put into the list of its nearest centroid, and
each list stores its radius, the greatest distance of a row from the centroid.  The score of a
query q with any row of a list lies within q.c - |q| r and q.c + |q| r.  A query visits lists by falling upper
bound, skips those whose range lies outside its window of scores, and stops when the next upper
bound is strictly below its k-th score; so results are exact.

Visits go in rounds: the lists of the first ranks, then four times as many, until no query has one left.  In a
round, queries meet the lists they visit by a shuffle: lists are cut into tiles of ``TILE`` rows and the
queries of a list into blocks, so a task holds one tile and one block however large a list or its
audience is.  What all tasks share is a centroid and a radius for each list, ``MOST_LISTS`` at most.

First the positives of each anchor are searched (same label, no window), then the negatives for all windows of
an anchor at once.

Defined results: rows with a null id, a null label, a null or empty vector, or null or non-finite components
take no part; only vectors of equal length are compared; rows that repeat an id are one, the first by label
and then by components; scores beyond 64 bits are held at the end of the range, where they tie; an anchor without
positives, or a positive without negatives in its window (always so for scores below zero), gives no row; an empty
table gives an empty result; columns other than the three named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .topk import best, matrices, products

#: Rows and bytes of the k-means sample; rows of a list aimed at; most lists; rows of a tile; queries of a block.
SAMPLE_ROWS, SAMPLE_BYTES, LIST_ROWS, MOST_LISTS, TILE, AUDIENCE = 20_000, 64_000_000, 1_024, 512, 8_192, 2_048
#: The most frequent lengths get lists by k-means, each other length one list around zero.
MOST_LENGTHS = 16
#: Lists of the first round, and the growth from round to round.
FIRST, GROWTH = 8, 4
LEAST, MOST = -(2**63), 2**63 - 1

C = F.col


def centroids(x: np.ndarray, k: int, seed: int = 7, steps: int = 10) -> np.ndarray:
    """Lloyd's k-means on the sample."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = nearest(x, centers)[0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))[:, None]
        centers = np.where(n > 0, sums / np.maximum(n, 1), centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row and the distance from it."""
    near = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4_096):
        near[at : at + 4_096] = ((centers**2).sum(1)[None] - 2 * x[at : at + 4_096] @ centers.T).argmin(1)
    return near, np.sqrt(((x - centers[near]) ** 2).sum(1))


class Index:
    """Centroids, radii and sizes of all lists; numbers of lists run through all vector lengths."""

    def __init__(self, samples: dict[int, np.ndarray], rows: dict[int, int]):
        self.first, self.centers, at = {}, {}, 0
        for dim, n in sorted(rows.items()):
            x = samples.get(dim, np.zeros((1, dim)))
            self.centers[dim] = centroids(x, max(1, min(MOST_LISTS, n // LIST_ROWS)))
            self.first[dim], at = at, at + len(self.centers[dim])
        self.radii, self.sizes = np.zeros(at), np.zeros(at, np.int64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that any row of each list of the same length can have; widened by rounding errors."""
        c, at = self.centers[q.shape[1]], self.first[q.shape[1]]
        middle, norm = q @ c.T, np.sqrt((q**2).sum(1))[:, None]
        reach = norm * self.radii[at : at + len(c)][None]
        slack = 1e-9 * (norm * np.sqrt((c**2).sum(1))[None] + reach) + 1e-6
        return np.clip(middle - reach - slack, LEAST, MOST), np.clip(middle + reach + slack, LEAST, MOST)


def sound_rows(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and the vector of whole numbers of the rows that take part, one for each id."""
    v = F.transform(C(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    sound = F.coalesce(F.forall(C(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.filter(C(f"`{id_col}`").isNotNull() & label.isNotNull() & sound & (F.size(f"`{vector_col}`") > 0))
    rows = common.keep(rows.select(C(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("vector")), "vectors")
    again = common.keep(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated")
    n = again.count()
    if not n:
        return rows
    again = F.broadcast(again) if n <= common.BROADCAST_ROWS else again
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.label", "v.vector")
    return common.keep(rows.join(again, "vec_id", "left_anti").unionByName(one), "vectors")


def build(rows: DataFrame) -> tuple[DataFrame, object]:
    """The rows with list and tile, written, and the broadcast index."""
    spark = rows.sparkSession
    size = F.size("vector")
    rows_of = {r.dim: r.n for r in rows.groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    samples, left = {}, SAMPLE_BYTES
    for dim, n in sorted(((d, n) for d, n in rows_of.items() if n >= 2 * LIST_ROWS), key=lambda x: -x[1])[:MOST_LENGTHS]:
        want = min(SAMPLE_ROWS, left // (8 * dim))
        part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(2**31)) < int(2**31 * min(1.0, 1.2 * want / n))
        if want:
            found = matrices(rows.filter((size == dim) & part).limit(want).select("vec_id", "vector").toArrow())
            samples |= {d: x for d, (_, x) in found.items()}
            left -= sum(x.nbytes for _, x in found.values())
    index = Index(samples, rows_of)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            for dim, (ids, labels, x) in by_length(b).items():
                if dim in shared.value.first:
                    near, far = nearest(x, shared.value.centers[dim])
                    yield pa.record_batch({"list": near + shared.value.first[dim], "far": far, "vec_id": ids, "label": labels, "vector": listed(x)})

    rows = common.keep(rows.mapInArrow(assign, "list long, far double, vec_id long, label long, vector array<double>"), "lists")
    for r in rows.groupBy("list").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        index.radii[r.list], index.sizes[r.list] = r.far, r.n
    shared.unpersist()
    return rows.drop("far"), spark.sparkContext.broadcast(index)


def by_length(b: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors by the length of the vector."""
    places = pa.record_batch({"vec_id": pa.array(np.arange(b.num_rows)), "vector": b["vector"]})
    ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
    return {dim: (ids[at], labels[at], x) for dim, (at, x) in matrices(places).items()}


def listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


WINDOW = "windows array<struct<tag:long,low:long,high:long,kth:long>>"
QUERY = f"anchor_id long, label long, vector array<double>, {WINDOW}"


def visits(queries: DataFrame, index, start: int, stop: int) -> DataFrame:
    """A row for every query and list to visit in this round: ranks ``start`` to ``stop`` by upper bound, in some window, and not strictly below its k-th score."""

    def go(batches):
        for b in batches:
            for i in range(b.num_rows):
                q = np.array(b["vector"][i].values.to_numpy()[None])
                w = b["windows"][i].values
                low, high, kth = (w.field(n).to_numpy()[:, None].astype(float) for n in ("low", "high", "kth"))
                least, most = index.value.bounds(q)
                order = np.argsort(-most[0], kind="stable")[start:stop]
                wanted = ((most[:, order] >= np.maximum(low, kth)) & (least[:, order] <= high)).any(0)
                to = order[wanted] + index.value.first[q.shape[1]]
                if len(to):
                    one = b.slice(i, 1)
                    yield pa.record_batch([pa.array(to), *[c.take(pa.array(np.zeros(len(to), np.int64))) for c in one.columns]], names=["list", *b.schema.names])

    return queries.mapInArrow(go, f"list long, {QUERY}")


def tile_lists(k: int, same: bool):
    """Queries of a block against the rows of a tile: the k best of every window."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, x = right["vec_id"].to_numpy(), right["label"].to_numpy(), matrices(right)
        ((_, x),) = x.values()
        found = []
        for at in range(0, left.num_rows, 256):
            some = left.slice(at, 256)
            q = some["vector"].combine_chunks()
            s = products(q.flatten().to_numpy().reshape(len(some), -1), x)
            own, own_label = some["anchor_id"].to_numpy(), some["label"].to_numpy()
            may = (ids[None] != own[:, None]) & ((labels[None] == own_label[:, None]) == same)
            w = some["windows"].combine_chunks()
            of = np.repeat(np.arange(len(some)), w.value_lengths().to_numpy())
            tag, low, high, kth = (w.flatten().field(n).to_numpy() for n in ("tag", "low", "high", "kth"))
            for part in range(0, len(of), 256):
                p = slice(part, part + 256)
                mine = s[of[p]]
                allowed = may[of[p]] & (mine >= np.maximum(low, kth)[p, None]) & (mine <= high[p, None])
                r, j = best(mine, np.broadcast_to(ids, mine.shape), allowed, k)
                found.append((own[of[p]][r], tag[p][r], ids[j], mine[r, j]))
        columns = [np.concatenate([f[i] for f in found]) for i in range(4)]
        return pa.table(columns, names=["anchor_id", "tag", "vec_id", "score"])

    return go


def search(lists: DataFrame, index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, tag, vec_id, score and rank of the k best of every window of every query, by rounds of visits."""
    kept, start, stop = None, 0, FIRST
    tops = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))).filter(C("rank") <= k)
    most = max([len(c) for c in index.value.centers.values()], default=0)
    sizes = index.value.sizes
    while start < most:
        going = common.keep(visits(queries, index, start, stop), "visits")
        audience = {r.list: r.n for r in going.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
        if audience:
            cuts = lists.sparkSession.createDataFrame([(at, -(-int(sizes[at]) // TILE), -(-n // AUDIENCE)) for at, n in audience.items()], "list long, tiles int, seats int")
            cuts = F.broadcast(cuts)
            upto = lambda c: F.explode(F.sequence(F.lit(0), C(c) - 1))
            q = going.join(cuts, "list").select("list", *QUERY_NAMES, F.pmod(F.xxhash64("anchor_id"), C("seats")).cast("int").alias("seat"), upto("tiles").alias("tile"))
            c = lists.join(cuts, "list").select("list", "vec_id", "label", "vector", F.pmod(F.xxhash64("vec_id"), C("tiles")).cast("int").alias("tile"), upto("seats").alias("seat"))
            keys = ["list", "tile", "seat"]
            found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(either(tile_lists(k, same)), "anchor_id long, tag long, vec_id long, score long")
            found = found if kept is None else found.unionByName(kept.drop("rank"))
            kept = common.keep(tops(found), "tops")
            full = kept.filter(C("rank") == k).select("anchor_id", "tag", C("score").alias("found"))
            queries = raised(queries, full)
        start, stop = stop, stop + (stop - start) * GROWTH
    return kept if kept is not None else tops(lists.sparkSession.createDataFrame([], "anchor_id long, tag long, vec_id long, score long"))


QUERY_NAMES = ["anchor_id", "label", "vector", "windows"]


def either(f):
    """A side without rows meets nobody."""
    empty = pa.schema([(n, pa.int64()) for n in ("anchor_id", "tag", "vec_id", "score")]).empty_table()
    return lambda left, right: f(left, right) if left.num_rows and right.num_rows else empty


def raised(queries: DataFrame, full: DataFrame) -> DataFrame:
    """The queries with the k-th scores that were found."""
    per = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "found"))).alias("found"))
    found = lambda w: F.greatest(w["kth"], F.coalesce(F.try_element_at("found", w["tag"]), w["kth"]))
    windows = F.transform("windows", lambda w: F.struct(w["tag"].alias("tag"), w["low"].alias("low"), w["high"].alias("high"), found(w).alias("kth")))
    return common.keep(queries.join(per, "anchor_id", "left").withColumn("found", F.coalesce("found", F.create_map().cast("map<bigint,bigint>"))).select("anchor_id", "label", "vector", windows.alias("windows")), "queries")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score (``is_anchor`` speaks of vec_id).

    A negative's score n lies in the window of its positive's score p: low * p <= 100 * n <= high * p.
    """
    common.prepare(vectors.sparkSession)
    rows = sound_rows(vectors, label, scale, id_col, vector_col)
    lists, index = build(rows)
    anchors = common.keep(lists.filter(is_anchor).select(C("vec_id").alias("anchor_id"), "label", "vector"), "anchors")
    window = lambda tag, lo, hi: F.struct(tag.alias("tag"), lo.alias("low"), hi.alias("high"), F.lit(LEAST).alias("kth"))
    long = lambda x: F.lit(x).cast("long")
    first = search(lists, index, anchors.withColumn("windows", F.array(window(long(0), long(LEAST), long(MOST)))), positives, True)
    found = first.select("anchor_id", C("vec_id").alias("positive_id"), C("score").alias("positive_score"))
    # bounds as whole numbers, without products that leave 64 bits
    p = C("positive_score")
    least, most = F.ceil(p.cast("decimal(38,0)") * low / 100).cast("long"), F.floor(p.cast("decimal(38,0)") * high / 100).cast("long")
    windows = found.filter(least <= most).groupBy("anchor_id").agg(F.collect_list(window(C("positive_id"), least, most)).alias("windows"))
    second = search(lists, index, common.keep(anchors.join(windows, "anchor_id"), "queries"), negatives, False)
    out = second.select("anchor_id", C("tag").alias("positive_id"), "rank", C("vec_id").alias("negative_id"), C("score").alias("negative_score"))
    return out.join(found, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
