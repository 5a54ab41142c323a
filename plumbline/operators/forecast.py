"""Trends of snapshots: regression, projection, growing types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def regression(points: DataFrame) -> DataFrame:
    """Slope and intercept of y over x; flat through the mean where x doesn't vary (FC-1)."""
    out = points.agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("s", F.lit(0.0)).alias("slope"), F.coalesce(F.when(C("s").isNotNull(), C("i")), C("mean"), F.lit(0.0)).alias("intercept"), "n")


def trend(slope) -> F.Column:
    """improving, worsening or stable (FC-3)."""
    return F.when(slope < -0.05, "improving").when(slope > 0.05, "worsening").otherwise("stable")


def series(snapshots: DataFrame) -> DataFrame:
    """x in days since the first snapshot, y findings."""
    daily = snapshots.groupBy("day").agg(F.sum("n").cast("double").alias("y"))
    return daily.crossJoin(F.broadcast(daily.agg(F.min("day").alias("d0")))).select(F.datediff("day", "d0").cast("double").alias("x"), "y")


def forecast(snapshots: DataFrame, horizon: int = 90, least: int = 3) -> DataFrame:
    """Projected findings with a 95 % band (FC-2)."""
    points = series(snapshots)
    line = points.crossJoin(F.broadcast(regression(points).select("slope", "intercept")))
    out = line.groupBy("slope", "intercept").agg(F.sum(F.pow(C("y") - C("slope") * C("x") - C("intercept"), F.lit(2))).alias("ssr"), F.count(F.lit(1)).alias("n"), F.max("x").alias("last"))
    predicted = F.greatest(F.lit(0), F.bround(C("slope") * (C("last") + horizon) + C("intercept"), 0).cast("long"))
    margin = F.bround(1.96 * F.sqrt(C("ssr") / F.greatest(C("n") - 2, F.lit(1))), 0).cast("long")
    out = out.filter(C("n") >= max(2, least)).withColumn("predicted", predicted).withColumn("margin", margin)
    return out.select("predicted", F.greatest(F.lit(0), C("predicted") - C("margin")).alias("low"), (C("predicted") + C("margin")).alias("high"), trend(C("slope")).alias("trend"), F.round("slope", 4).alias("slope"), C("n").alias("snapshots"))


def split_forecast(snapshots: DataFrame, predicted: DataFrame) -> DataFrame:
    """The projection shared out like the latest snapshot (FC-2)."""
    latest = snapshots.join(F.broadcast(snapshots.agg(F.max("day").alias("day"))), "day")
    whole = latest.agg(F.sum("n").alias("whole"))
    return latest.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(predicted.select("predicted"))).select("kind", F.bround(C("predicted") * C("n") / C("whole"), 0).cast("long").alias("predicted"))


def growing(snapshots: DataFrame, k: int = 5) -> DataFrame:
    """Types that have grown most from the first to the last snapshot (SRT-7)."""
    ends = snapshots.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    rows = snapshots.crossJoin(F.broadcast(ends))
    at = lambda d: F.sum(F.when(C("day") == C(d), C("n")).otherwise(0))
    return rows.groupBy("kind").agg((at("last_day") - at("first_day")).alias("growth")).filter("growth > 0").orderBy(F.desc("growth"), "kind").limit(k)


def actions(forecasted: DataFrame) -> DataFrame:
    """Advice as text rows (FC-4)."""
    worse = C("trend") == "worsening"
    texts = F.array_compact(F.array(F.when(worse, F.format_string("Debt grows by %.1f findings a day", C("slope"))), F.when(worse & (C("predicted") > 100), F.lit("Plan a clean-up sprint")), F.when(C("trend") == "improving", F.lit("Keep the present pace")), F.when(C("trend") == "stable", F.lit("Watch the hotspots"))))
    return forecasted.select(F.explode(texts).alias("action"))
