"""Exact top-k search by tiled matrix products.

Queries go out in chunks of bounded bytes.  For each chunk the candidates are walked where they lie, a
tile of rows at a time: a matrix product, of which the k best of each query survive, merged with those
of the task's tiles before it.  A thirty-second of the candidates is walked first; the k-th score found there is
a floor under which no task hands out anything, so what is handed out for a query hardly grows with the number
of tasks.  The tasks' lists are merged in a tree before they are written.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
only vectors of equal length are compared; a query isn't compared with rows of its own id; rows that repeat
id and vector are one; the different vectors of one id are candidates of their own, and where the id asks, each
asks, and a candidate's score is the best of them; ties go to the smaller id; sums beyond 64 bits are held at the
end of the range, where they tie; an empty table gives an empty result; columns other than the id and the
vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of queries that are broadcast at once, candidates and queries of a tile, lists merged at once.
CHUNK_BYTES, CANDIDATE_BLOCK, QUERY_BLOCK, FAN = 32_000_000, 8_192, 256, 16
#: One in so many candidates is walked first, for floors, where there are more than so many.
SAMPLE, SAMPLED_FROM = 32, 1_000_000
EXACT = 2**53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of two float64 matrices of whole numbers; exact floats while sums stay below 2**53, else Python integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64) if exact.size else exact.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best allowed entries of each row: by score, then by the smaller id."""
    rows, cols = [], []
    for r in range(len(scores)):
        mine = np.flatnonzero(allowed[r])
        if len(mine) > k:
            v = scores[r, mine]
            edge = np.partition(v, len(v) - k)[len(v) - k]
            above, level = mine[v > edge], mine[v == edge]
            mine = np.concatenate([above, level[np.argsort(ids[r, level], kind="stable")][: k - len(above)]])
        rows.append(np.full(len(mine), r))
        cols.append(mine)
    return np.concatenate(rows).astype(np.int64), np.concatenate(cols).astype(np.int64)


class Lists:
    """The k best candidates so far of every query (rows of matrices of whole numbers): id, key of the vector, score."""

    def __init__(self, ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, k: int):
        self.own, self.floors, self.vectors, self.k = ids, floors, vectors, k
        self.ids, self.keys, self.scores = (np.zeros((len(ids), k), np.int64) for _ in range(3))
        self.full = np.zeros((len(ids), k), bool)

    def meet(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> None:
        """One tile: all queries against these candidates."""
        for at in range(0, len(self.own), QUERY_BLOCK):
            q = slice(at, at + QUERY_BLOCK)
            s = products(self.vectors[q], vectors)
            r, j = best(s, np.broadcast_to(ids, s.shape), (ids[None] != self.own[q, None]) & (s >= self.floors[q, None]), self.k)
            if not len(r):
                continue
            n = np.bincount(r, minlength=len(s))
            place = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            both = [np.hstack([old[q], np.zeros((len(s), self.k), old.dtype)]) for old in (self.ids, self.keys, self.scores, self.full)]
            for target, values in zip(both, (ids[j], keys[j], s[r, j], True), strict=True):
                target[r, self.k + place] = values
            r, j = best(both[2], both[0], both[3], self.k)
            n = np.bincount(r, minlength=len(s))
            place = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            self.full[q] = False
            for target, source in zip((self.ids, self.keys, self.scores, self.full), both, strict=True):
                target[at + r, place] = source[r, j]

    def batch(self, part: int) -> pa.RecordBatch:
        r, j = np.nonzero(self.full)
        return pa.record_batch({"query_id": self.own[r], "cblock": pa.array(np.full(len(r), part), pa.int32()), "vec_id": self.ids[r, j], "vkey": self.keys[r, j], "score": self.scores[r, j]})


def matrices(table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by length."""
    vectors, out = table["vector"], {}
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ids, sizes = table["vec_id"].to_numpy(), pc.list_value_length(vectors).to_numpy()
    for dim in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == dim)
        out[dim] = ids[some], vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), dim)
    return out


def distinct(rows: DataFrame) -> DataFrame:
    """One row for each id and vector: only the rows of ids that repeat are compared."""
    again = common.keep(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated")
    n = again.count()
    if not n:
        return rows
    again = F.broadcast(again) if n <= common.BROADCAST_ROWS else again
    some = rows.join(again, "vec_id", "left_semi").dropDuplicates(["vec_id", "vector"])
    return common.keep(rows.join(again, "vec_id", "left_anti").unionByName(some), "topk")


LISTS = "query_id long, cblock int, vec_id long, vkey long, score long"


def walk(candidates: DataFrame, shared, k: int) -> DataFrame:
    """The k best of every query of a chunk in every task, in as many tasks as there are cores."""

    def go(batches):
        found = {dim: Lists(*q, k) for dim, q in shared.value.items()}
        for b in batches:
            for at in range(0, b.num_rows, CANDIDATE_BLOCK):
                some = b.slice(at, CANDIDATE_BLOCK)
                places = pa.record_batch({"vec_id": pa.array(np.arange(some.num_rows)), "vector": some["vector"]})
                for dim, (i, vectors) in matrices(places).items():
                    if dim in found:
                        found[dim].meet(some["vec_id"].to_numpy()[i], some["vkey"].to_numpy()[i], vectors)
        for each in found.values():
            yield each.batch(TaskContext.get().partitionId())

    return candidates.coalesce(2 * candidates.sparkSession.sparkContext.defaultParallelism).mapInArrow(go, LISTS)


def ranked(lists: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best candidates of every query (and ``by``)."""
    best_of = lists.groupBy("query_id", *by, "vec_id", "vkey").agg(F.max("score").alias("score"))
    return best_of.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """The tasks' lists of all queries, merged in a tree."""
    while parts > FAN:
        parts = -(-parts // FAN)
        lists = ranked(lists.withColumn("cblock", F.floor(F.col("cblock") / FAN).cast("int")), k, "cblock").drop("rank")
    return ranked(lists, k)


def with_floors(asking: dict, floors: dict[int, int]) -> dict:
    """Ids, floors and vectors by length."""
    return {dim: (ids, np.fromiter((floors.get(i, -(2**63)) for i in ids.tolist()), np.int64, len(ids)), v) for dim, (ids, v) in asking.items()}


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (inner product of floor(scale * x)) of the k best of every query."""
    spark = common.prepare(vectors.sparkSession)
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    sound = F.coalesce(F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = common.columns(vectors, id_col, vector_col).filter(F.col(f"`{id_col}`").isNotNull() & sound & (F.size(f"`{vector_col}`") > 0)).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"), is_query.alias("asks")
    )
    rows = distinct(common.keep(rows.withColumn("vkey", F.xxhash64("vector")), "topk"))
    asking = rows.filter("asks").select("vec_id", "vkey", "vector")
    size = asking.agg(F.coalesce(F.sum(8 * (F.size("vector") + 3)), F.lit(0))).first()[0]
    chunks, lists = max(1, -(-size // CHUNK_BYTES)), None
    chunk = F.pmod(F.xxhash64("vec_id", "vkey"), F.lit(chunks))
    candidates = rows.select("vec_id", "vkey", "vector")
    parts, many = 2 * spark.sparkContext.defaultParallelism, rows.count() > SAMPLED_FROM
    for c in range(chunks):
        queries = matrices(asking.filter(chunk == c).toArrow())
        floors = {}
        if many:
            shared = spark.sparkContext.broadcast(with_floors(queries, {}))
            sample = candidates.filter(F.pmod(F.xxhash64("vkey"), F.lit(SAMPLE)) == 0)
            seen = common.keep(merged(walk(sample, shared, k), parts, k), "floors").filter(F.col("rank") == k)
            floors = dict(seen.select("query_id", "score").collect())  # one number a query of the chunk
            shared.unpersist()
        shared = spark.sparkContext.broadcast(with_floors(queries, floors))
        part = common.keep(merged(walk(candidates, shared, k), parts, k), "toplists")
        shared.unpersist()
        lists = part if lists is None else lists.unionByName(part)
    return (lists if chunks == 1 else ranked(lists, k)).select("query_id", "rank", "vec_id", "score")
