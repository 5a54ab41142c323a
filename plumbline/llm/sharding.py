"""Sharding by fixed virtual slots.

A record's hash puts it into one of ``slots`` virtual slots for ever; a small versioned map says
which shard holds each slot.  The map is made from the bytes that each slot holds, and later
versions move whole slots, never single records.

Defined results: null texts have size 1 and the crc32 of nothing; null ids are kept and hashed as
such; repeated rows are separate records; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOTS = 16_384


@dataclass
class SlotMap:
    """``shard_of[slot]``; every edit makes a new version."""

    shards: int
    shard_of: list[int]
    version: int = 1
    history: list[str] = field(default_factory=list)

    @classmethod
    def balanced(cls, size_of: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes so far."""
        heap = [(0, s) for s in range(shards)]
        shard_of = [0] * slots
        for slot in sorted(range(slots), key=lambda k: (-size_of.get(k, 0), k)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + size_of.get(slot, 0), shard))
        return cls(shards, shard_of, 1, [f"balanced over {shards}"])

    def loads(self, size_of: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += size_of.get(slot, 0)
        return out

    def grown(self, size_of: dict[int, int]) -> SlotMap:
        """One more shard: slots move into it alone, from the fullest shards, until it holds its part."""
        new, load = self.shards, self.loads(size_of)
        goal = sum(load) / (new + 1)
        members: dict[int, list[int]] = {s: [] for s in range(new)}
        for slot, shard in enumerate(self.shard_of):
            members[shard].append(slot)
        for m in members.values():
            m.sort(key=lambda k: size_of.get(k, 0))
        shard_of, got = list(self.shard_of), 0
        heap = [(-load[s], s) for s in range(new)]
        heapq.heapify(heap)
        while heap and got < goal:
            full, s = heapq.heappop(heap)
            while members[s]:
                slot = members[s].pop()
                size = size_of.get(slot, 0)
                if size and got + size <= goal:
                    shard_of[slot], got = new, got + size
                    heapq.heappush(heap, (full + size, s))
                    break
        return SlotMap(new + 1, shard_of, self.version + 1, [*self.history, f"shard {new} added"])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, s, self.version) for k, s in enumerate(self.shard_of)], "vslot int, shard int, map_version int")

    def save(self, spark: SparkSession, folder: str) -> str:
        """Write this version beside the earlier ones, as one row."""
        path = f"{folder}/version={self.version:06d}"
        spark.createDataFrame([(self.shards, json.dumps(self.shard_of), json.dumps(self.history))], "shards int, shard_of string, history string").coalesce(1).write.mode("overwrite").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(folder)
        row = rows.filter(F.col("version") == version).first() if version else rows.orderBy(F.desc("version")).first()
        return cls(row.shards, json.loads(row.shard_of), int(row.version), json.loads(row.history))


def sizes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record.  The slot hashes id and content, so that a repeated id spreads."""
    content = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return common.columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.length(content) + F.lit(1)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", F.crc32(content), F.length(content)), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and records of each virtual slot: at most as many rows as there are slots."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def assign(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_folder: str | None = None, slot_map: SlotMap | None = None, grown: bool = False) -> DataFrame:
    """Every record with its shard and its place there (``slot``, gapless from 0).

    With ``map_folder`` the map is stored there and the stored version is what counts.  ``grown`` adds where each record lies
    in the next version, which has one shard more and is stored beside it.  The per-slot totals (one row for each of the fixed slots) come to the driver, where the map is
    made; places are counted inside each virtual slot and moved by the slots before it.
    """
    spark = docs.sparkSession
    records = common.keep(sizes(docs, slots), "sharding")
    per_slot = {r.vslot: (r.bytes, r.n) for r in slot_sizes(records).collect()}
    m = slot_map or SlotMap.balanced({k: b for k, (b, _) in per_slot.items()}, shards, slots)
    if map_folder:
        m.save(spark, map_folder)
        m = SlotMap.load(spark, map_folder, m.version)
    following = m
    if grown:
        following = m.grown({k: b for k, (b, _) in per_slot.items()})
        if map_folder:
            following.save(spark, map_folder)
            following = SlotMap.load(spark, map_folder, following.version)
    first, rows = [0] * m.shards, []
    for k, shard in enumerate(m.shard_of):
        rows.append((k, shard, first[shard], m.version, following.shard_of[k], following.version))
        first[shard] += per_slot.get(k, (0, 0))[1]
    table = spark.createDataFrame(rows, "vslot int, shard int, first long, map_version int, next_shard int, next_version int")
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("inside", inside).join(F.broadcast(table), "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside") - 1).alias("slot"), "vslot", "map_version", *(("next_shard", "next_version") if grown else ())
    )
