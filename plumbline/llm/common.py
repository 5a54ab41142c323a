"""What several operators share: intermediate tables, shipping this package, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension table is broadcast up to so many rows; beyond that it is joined by a shuffle.
BROADCAST_ROWS = 20_000

_shipped: dict[str, bool] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once for each application."""
    context = spark.sparkContext
    if not _shipped.get(context.applicationId):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(), "plumbline.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
        _shipped[context.applicationId] = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    ``settings`` hold while it is written (dots as double underscores).
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    settings = {k.replace("__", "."): v for k, v in settings.items()}
    settings["spark.sql.classic.shuffleDependency.fileCleanup.enabled"] = "true"  # the shuffle files of this one write go with it
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._kept_at = path
    return back


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``keep`` that no later step reads."""
    path = getattr(df, "_kept_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text, a key of the row (``rid``), and all columns but the text as a struct (``row``), so that no name can clash.

    The key comes from the file and the place in it where the rows are read from files; else the rows
    are written once, with a number each.  Either way it is the same whenever a task is run again.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    base = [F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")]
    try:
        return docs.select(*base, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("rid"), row)
    except AnalysisException:
        return keep(docs.select(*base, F.monotonically_increasing_id().alias("rid"), row), "rows")


def restored(rows: DataFrame, docs: DataFrame, **changed: Column | None) -> DataFrame:
    """The columns of ``docs`` again from ``row`` and ``text``, with some of them changed."""
    changed = {"text": F.col("text"), **changed}
    return rows.select(*[(changed[c] if changed.get(c) is not None else F.col("row").getField(c)).alias(c) for c in docs.columns])


#: A key that holds more than this part of all rows is hot; fewer keys than HOT_PARTS can be.
HOT_PARTS = 1_000


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], place: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with the struct ``v`` of their key; ``table`` has one row for each key with ``v`` and its number of rows, ``copies``.

    Hot keys, of which there are fewer than ``parts`` by counting, are broadcast, and their rows are dealt by
    the columns ``place``; all others meet by a shuffle on the key.
    """
    parts = parts or HOT_PARTS
    bound = table.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // parts
    names = [f"key_{i}" for i in range(len(keys))]
    hot = table.filter(F.col("copies") > max(bound, 1)) if bound else table.limit(0)
    rest = table.filter(F.col("copies") <= max(bound, 1)) if bound else table
    met = rows.join(F.broadcast(hot.select(*keys, F.col("v").alias("hot"))), keys, "left").withColumn("cold", F.col("hot").isNull())
    for i, (k, name) in enumerate(zip(keys, names, strict=True)):
        met = met.withColumn(name, F.when(F.col("cold"), F.col(k)).otherwise(F.pmod(F.xxhash64(F.lit(i), *place), F.lit(2**31 - 1)).cast(table.schema[k].dataType)))
    rest = rest.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.lit(True).alias("cold"), F.col("v").alias("rest"))
    return met.join(rest, [*names, "cold"], "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("hot", "rest").alias("v"))


def join_dimension(df: DataFrame, dim: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join a table with one row for each key: broadcast behind a row count, else a shuffle that Spark may split."""
    n = dim.count() if rows is None else rows
    return df.join(F.broadcast(dim) if n <= BROADCAST_ROWS else dim.hint("merge"), key, how)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (multiply and shift, twice)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def string_hashes(words: list[str], seed: int = 0) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))
