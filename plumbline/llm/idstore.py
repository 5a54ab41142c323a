"""Token ids in binary shards with a minimal perfect hash index.

A shard file holds, one after the other: the raw ids, the record offsets, the record keys, and an
index made of bucket displacements, fingerprints and (first record, records) entries; a footer says
where each part begins.  Looking up a key hashes it to a bucket, reads the bucket's displacement,
and so knows the key's slot at once; the fingerprint there tells strange keys from stored ones.

Files go to the shared folder under a temporary name and are renamed when whole, so a task that is
run again, or twice, leaves one whole file.  The manifest, a table with one row for each shard, gives
the order; the ids before each shard are summed over blocks of shards, then within them.

Defined results: a null text is an empty document, which still has its end id; null ids come first
and are found by scans only; records that repeat an id lie side by side, in order of their texts'
checksums, under one index entry of each shard they reach into; ids that don't fit ``width`` bytes
are an error; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, wordtok

MAGIC, END = b"PLMBIDS1", 1
BUCKET = 4
SHARDS_OF_BLOCK = 4_096
SINGLE = np.int64(1) << np.int64(40)


def hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, base and step of the slot, fingerprint."""
    k = np.asarray(keys, np.int64).view(np.uint64)
    a = common.mix64(k ^ np.uint64(0xA5A5A5A55A5A5A5A))
    b = common.mix64(a + np.uint64(0x9E3779B97F4A7C15))
    c = common.mix64(b + np.uint64(0x9E3779B97F4A7C15))
    return a, b, c | np.uint64(1), (common.mix64(c) >> np.uint64(32)).astype(np.uint32)


def slots(base: np.ndarray, step: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The slot under a bucket's displacement; from SINGLE on the displacement names the slot itself."""
    direct = shift >= SINGLE
    moved = common.mix64(base + step * shift.astype(np.uint64)) % np.uint64(max(n, 1))
    return np.where(direct, shift - SINGLE, moved.astype(np.int64))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the buckets and the slot of every key; keys are distinct.

    The fullest buckets choose first, each the first displacement that puts all its keys on free
    slots; buckets of one key take the slots that are left.
    """
    n = len(keys)
    buckets = max(1, -(-n // BUCKET))
    a, base, step, _ = hashes(keys)
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    first = np.cumsum(size) - size
    shift, free, slot = np.zeros(buckets, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-size, kind="stable").tolist():
        m = int(size[b])
        if m < 2:
            break
        mine = order[first[b] : first[b] + m]
        tried = 0
        while True:
            d = np.arange(tried, tried + 64, dtype=np.uint64)
            at = (common.mix64(base[mine][:, None] + step[mine][:, None] * d) % np.uint64(n)).astype(np.int64)
            ordered = np.sort(at, axis=0)
            good = free[at].all(axis=0) & (ordered[1:] != ordered[:-1]).all(axis=0)
            if good.any():
                k = int(good.argmax())
                shift[b], slot[mine] = tried + k, at[:, k]
                free[at[:, k]] = False
                break
            tried += 64
    alone = np.flatnonzero(size == 1)
    left = np.flatnonzero(free)
    shift[alone], slot[order[first[alone]]] = SINGLE + left, left
    return shift, slot


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; Spark's name for the store of objects is pyarrow's under another scheme."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class ShardWriter:
    """Appends records in ascending order of key; ``close`` adds the index."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = opened(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.width, self.keys, self.lengths, self.nulls = width, [], [], 0

    def add(self, keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(ids, f"<u{self.width}").tobytes())
        self.nulls += keys.null_count
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
        self.lengths.append(lengths)

    def close(self) -> dict:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths))]).astype(np.int64) if self.keys else np.zeros(1, np.int64)
        known, first, n = np.unique(keys[self.nulls :], return_index=True, return_counts=True)
        shift, slot = build(known)
        prints, entries = np.zeros(len(known), np.uint32), np.zeros((len(known), 2), np.int64)
        prints[slot], entries[slot] = hashes(known)[3], np.stack([first + self.nulls, n], axis=1)
        head = {"records": len(keys), "keys": len(known), "nulls": self.nulls, "width": self.width, "ids": int(offsets[-1]), "parts": {}}
        at = int(offsets[-1]) * self.width
        for name, part in (("offsets", offsets), ("record_keys", keys), ("shift", shift), ("prints", prints), ("entries", entries)):
            raw = np.ascontiguousarray(part).tobytes()
            head["parts"][name] = [at, len(raw)]
            self.out.write(raw)
            at += len(raw)
        foot = json.dumps(head).encode()
        self.out.write(foot + struct.pack("<q", len(foot)) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return head


@dataclass
class Shard:
    """An open shard: keyed access to the ids of a record."""

    uri: str

    def __post_init__(self):
        fs, path = opened(self.uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{self.uri} isn't a whole shard")
        n = struct.unpack("<q", tail[:8])[0]
        self.head = json.loads(self.file.read_at(n, size - 16 - n))
        part = lambda name, kind: np.frombuffer(self.file.read_at(self.head["parts"][name][1], self.head["parts"][name][0]), kind)
        self.offsets, self.record_keys, self.shift, self.prints = part("offsets", "<i8"), part("record_keys", "<i8"), part("shift", "<i8"), part("prints", "<u4")
        self.entries = part("entries", "<i8").reshape(-1, 2)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records where the key isn't stored."""
        n = len(self.prints)
        if not n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        a, base, step, prints = hashes(keys)
        s = slots(base, step, self.shift[(a % np.uint64(len(self.shift))).astype(np.int64)], n)
        return self.entries[s, 0], np.where(self.prints[s] == prints, self.entries[s, 1], 0)

    def ids(self, record: int) -> np.ndarray:
        w = self.head["width"]
        a, b = int(self.offsets[record]), int(self.offsets[record + 1])
        return np.frombuffer(self.file.read_at((b - a) * w, a * w), f"<u{w}")

    def runs(self, size: int = 16_000_000):
        """(first record, end record, raw ids) of all records in order, read in ranges of about ``size`` bytes."""
        w, at, n = self.head["width"], 0, self.head["records"]
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + size // w, "right")) - 1)
            to = min(to, n)
            a, b = int(self.offsets[at]), int(self.offsets[to])
            yield at, to, np.frombuffer(self.file.read_at((b - a) * w, a * w), f"<u{w}")
            at = to

    def get(self, key: int) -> list[np.ndarray]:
        first, n = self.find(np.array([key], np.int64))
        return [self.ids(r) for r in range(int(first[0]), int(first[0] + n[0]))]


MANIFEST = "shard int, uri string, records long, ids long, first_id long, last_id long"


def write(docs: DataFrame, folder: str, shards: int, vocabulary: str | None = None, end: int = END, width: int = 2) -> DataFrame:
    """Encode all documents and write the shards in ascending order of doc_id; returns the manifest."""
    common.prepare(docs.sparkSession)
    vocabulary = vocabulary or wordtok.default_vocabulary()

    def go(batches):
        shard, writer, ends = TaskContext.get().partitionId(), None, []
        encoder = wordtok.encoder(vocabulary)
        for b in batches:
            if not b.num_rows:
                continue
            uri = f"{folder}/shard-{shard:06d}.ids"
            writer = writer or ShardWriter(uri, width)
            offsets, ids = encoder.encode(b["text"])
            if max(int(ids.max(initial=0)), end) >= 1 << (8 * width):
                raise ValueError("ids don't fit the width")
            writer.add(b["doc_id"], np.diff(offsets) + 1, np.insert(ids, offsets[1:], end))
            ends += [b["doc_id"][0].as_py(), b["doc_id"][-1].as_py()]
        encoder.release()
        if writer:
            head = writer.close()
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "uri": [uri], "records": [head["records"]], "ids": [head["ids"]], "first_id": pa.array([ends[0]], pa.int64()), "last_id": pa.array([ends[-1]], pa.int64())})

    rows = common.row_ids(docs).select("doc_id", "rid", "text", F.crc32(F.encode("text", "UTF-8")).alias("crc"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc").asc_nulls_first(), F.col("rid").asc()]  # a repeated id may reach over shards
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return common.keep(ranged.mapInArrow(go, MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, each found through the index of its shard's file."""
    common.prepare(spark)
    blocked = manifest.withColumn("block", F.floor(F.col("shard") / SHARDS_OF_BLOCK))
    totals = blocked.groupBy("block").agg(F.sum("ids").alias("total"))
    bases = totals.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = common.keep(blocked.withColumn("inside", inside).join(bases, "block").select("uri", (F.col("base") + F.col("inside")).alias("before")), "places")

    def go(batches):
        for b in batches:
            for uri, before in zip(b["uri"].to_pylist(), b["before"].to_pylist(), strict=True):
                shard = Shard(uri)
                nulls = shard.head["nulls"]
                known = np.unique(shard.record_keys[nulls:])
                first, n = shard.find(known)
                if int(n.sum()) + nulls != shard.head["records"]:
                    raise ValueError(f"the index of {uri} misses records")
                place = np.concatenate([np.arange(nulls), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]).astype(np.int64)
                if (place != np.arange(len(place))).any():
                    raise ValueError(f"the index of {uri} leads to other records")
                for at, to, raw in shard.runs():
                    part, ends = np.arange(at, to), shard.offsets[at : to + 1] - shard.offsets[at]
                    data = memoryview(np.ascontiguousarray(raw, "<u4")).cast("B") if len(raw) else b""
                    crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    keys = pa.array(shard.record_keys[part], pa.int64(), mask=part < nulls)
                    yield pa.record_batch({"doc_id": keys, "start": before + shard.offsets[part], "n_tokens": np.diff(ends), "ids_crc32": pa.array(crc, pa.int64())})

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return table.repartition(max(1, table.count())).mapInArrow(go, shape)


def shard_count(docs: DataFrame, rows: int = 20_000, size: int = 64_000_000) -> int:
    """Shards of at most about so many records and bytes of text."""
    n, b = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-n // rows), -(-b // size))
