"""An append-only table with a commit log: whole batches or nothing, each once.

A batch is written aside, moved to its place ``data/batch=<id>`` in one step, and named by a numbered manifest in
``log``.  Neither step replaces what is there: a batch that is tried again, at once or after a crash between the two, finds
itself and adds nothing; of two writers with one number the later takes the next.  Readers join the data with the
manifests they see, so they see whole batches, up to any version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

C = F.col
MANIFEST = "version long, batch string, rows long"


class Store:
    """Files of one folder, by the file system that the folder lies in."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.fs = spark, folder.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        at = self.fs.Path(self.folder)
        self.files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = at.makeQualified(self.files.getUri(), self.files.getWorkingDirectory()).toString()
        self.context = self.fs.FileContext.getFileContext(self.files.getUri(), spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.fs.Path(f"{self.folder}/{name}")

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(f.getPath().getName() for f in self.files.listStatus(at)) if self.files.exists(at) else []

    def put(self, source: str, target: str) -> bool:
        """Move a file or folder to a place that must be free; the source goes if it isn't."""
        self.files.mkdirs(self.path(target).getParent())
        none = self.spark.sparkContext._gateway.new_array(self.fs.Options.Rename, 0)
        try:
            self.context.rename(self.path(source), self.path(target), none)
            return True
        except Exception:
            if not self.files.exists(self.path(target)):
                raise
            self.files.delete(self.path(source), True)
            return False

    def put_text(self, text: str, target: str) -> bool:
        aside = f"_aside/{uuid.uuid4().hex}"
        out = self.files.create(self.path(aside), False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        return self.put(aside, target)


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The manifests: version, batch and rows of each commit."""
    store = Store(spark, folder)
    return spark.read.schema(MANIFEST).json(f"{store.folder}/log") if store.names("log") else spark.createDataFrame([], MANIFEST)


def committed(spark: SparkSession, folder: str, batch: str) -> int | None:
    row = versions(spark, folder).filter(C("batch") == batch).select("version").first()
    return row and row.version


def append(df: DataFrame, folder: str, batch: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> int:
    """Commit the rows as batch ``batch`` (a name without slashes) and give its version; a batch that is there already is left as it is.

    ``by`` names folders inside the batch, ``order`` the order of rows from file to file.
    """
    spark, store = df.sparkSession, Store(df.sparkSession, folder)
    done = committed(spark, folder, batch)
    if done is not None:
        return done
    place = f"data/batch={batch}"
    aside, seen = f"_aside/{uuid.uuid4().hex}", Observation()
    rows = df.orderBy(*order) if order else df
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*by).json(f"{store.folder}/{aside}")
    n = seen.get["rows"]
    if not store.put(aside, place):
        n = spark.read.text(f"{store.folder}/{place}").count()  # an earlier try came as far as this
    last = max((int(x.split(".")[0]) for x in store.names("log")), default=0)
    while True:
        last += 1
        if store.put_text(json.dumps({"version": last, "batch": batch, "rows": n}) + "\n", f"log/{last:012d}.json"):
            return last
        done = committed(spark, folder, batch)
        if done is not None:
            return done


def read(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of all commits, or of those up to ``version``, with ``version`` beside them.

    There is a manifest for each commit, so they are joined as a dimension: broadcast while they are few, and folders
    of other batches are pruned.
    """
    log = versions(spark, folder).select("batch", "version")
    log = log if version is None else log.filter(C("version") <= version)
    if not Store(spark, folder).names("data"):
        return spark.createDataFrame([], schema).withColumn("version", F.lit(None).cast("long"))
    return spark.read.schema(f"{schema}, batch string").json(f"{Store(spark, folder).folder}/data").join(log, "batch").drop("batch")


def stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New batches as a stream: a batch appears at its place whole and once."""
    store = Store(spark, folder)
    store.files.mkdirs(store.path("data"))
    return spark.readStream.schema(f"{schema}, batch string").json(f"{store.folder}/data").drop("batch")


def sink(rows: DataFrame, folder: str, name: str, checkpoint: str, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Commit every micro-batch once: its number in the stream ``name`` is its batch id."""
    return rows.writeStream.foreachBatch(lambda df, n: append(df, folder, f"{name}-{n:012d}", by) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
