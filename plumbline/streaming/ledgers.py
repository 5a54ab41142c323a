"""Append-only ledgers as streams.  Each runs with ``availableNow``, so its result equals the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import commits

C = F.col
COSTS = "seq long, period string, team string, operation string, cost_usd double"
FINDINGS = "seq long, fingerprint string, finding string"


def ledger(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New files of a JSON-lines ledger."""
    return spark.readStream.schema(schema).json(folder)


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New batches of a ledger that ``append`` fills."""
    return commits.stream(spark, folder, schema)


def spend(stream: DataFrame) -> DataFrame:
    """Running total of each period and team (STM-1)."""
    return stream.groupBy("period", "team").agg(F.sum("cost_usd").alias("spent"), F.count(F.lit(1)).alias("entries"))


def first_seen(stream: DataFrame) -> DataFrame:
    """Findings whose fingerprint hasn't been seen by the stream (STM-5)."""
    return stream.dropDuplicates(["fingerprint"])


def audited(df: DataFrame) -> DataFrame:
    """Entries with a hash of their own canonical form: columns in order of name, as JSON (STM-3)."""
    return df.withColumn("entry_hash", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))


def append(df: DataFrame, folder: str, batch: str) -> int:
    """Append a batch of rows to a ledger, a folder for each period; the same batch again adds nothing (STM-2)."""
    return commits.append(df, folder, batch, by=("period",))


def run(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Work through what is there and stop; the result is the table ``name``."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rescored(events: DataFrame, findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch of events into the scores that the one before left (STM-7).

    The findings after batch n are the folder ``batch=n``, written over if the batch is run again; the next
    batch begins with it.  Boosts add up over batches and a pause stays, as in one batch over all events.
    """
    from ..operators.scoring import reprioritise

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = spark.read.parquet(f"{path}/batch={number - 1}") if number else findings.withColumn("paused", F.lit(False)).withColumn("n_boosts", F.lit(0).cast("long"))
        new = reprioritise(now, batch).select("seq", "priority", C("paused").alias("_paused"), C("n_boosts").alias("_boosts"))
        after = now.join(new, "seq", "left")
        after = after.withColumn("priority_score", F.coalesce("priority", "priority_score")).withColumn("paused", C("paused") | F.coalesce("_paused", F.lit(False)))
        after = after.withColumn("n_boosts", C("n_boosts") + F.coalesce("_boosts", F.lit(0)))
        after.drop("priority", "_paused", "_boosts").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts by window and type with a watermark: an extension of this library."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(C("w.start").alias("start"), "event_type", "n")
