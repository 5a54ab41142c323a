"""Reports over findings and ledgers.  Long rows come out; maps and documents are made by the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from . import running

C = F.col


def by_type_and_severity(df: DataFrame) -> DataFrame:
    """Both distributions from one pass (AGG-1, AGG-32)."""
    rows = df.groupingSets([["type"], ["severity"]], "type", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping("type").alias("g"))
    return rows.select(F.when(C("g") == 0, "type").otherwise("severity").alias("facet"), F.when(C("g") == 0, C("type")).otherwise(C("severity")).alias("value"), "n")


def dashboard(findings: DataFrame, plans: DataFrame, forecast: DataFrame) -> DataFrame:
    """Both distributions, the number of all findings and of plans at hand, and the forecast where there is one (AGG-7)."""
    n = F.count(F.lit(1)).alias("n")
    rows = by_type_and_severity(findings)
    for facet, df in (("total", findings), ("plans", plans)):
        rows = rows.unionByName(df.agg(n).select(F.lit(facet).alias("facet"), F.lit("").alias("value"), "n"))
    return rows.unionByName(forecast.select(F.lit("trend").alias("facet"), C("trend").alias("value"), C("predicted").cast("long").alias("n")))


def hotspots(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values, ties in first-seen order (AGG-2)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(k)


def average_severity(df: DataFrame) -> DataFrame:
    """Mean of 5 to 1 (AGG-3)."""
    return df.agg(F.round(F.avg(dims.pick("severity", dims.SEVERITY_SCORE, 0).cast("double")), 2).alias("avg_severity"))


def scan_summary(df: DataFrame, rate: float = 85.0) -> DataFrame:
    """Totals, shares and the effort that findings stand for (AGG-4)."""
    n = F.count(F.lit(1))
    shares = [F.sum((C("severity") == s).cast("long")).alias(f"n_{s}") for s in dims.SEVERITY_RANK]
    out = df.agg(n.alias("total"), F.count_distinct("file").alias("files"), *shares)
    hours = C("n_critical") * 4.0 + C("n_high") * 2.0 + C("n_medium") * 1.0 + C("n_low") * 0.5
    return out.withColumn("manual_hours", hours).withColumn("savings_usd", hours * rate).withColumn("pct_critical", F.round(100.0 * C("n_critical") / C("total"), 4))


def review_summary(df: DataFrame, block_on: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    """Risk, blocking issues, status and suggested labels of a review (AGG-5)."""
    n = lambda column, value: F.sum((C(column) == value).cast("long"))
    blocking = F.sum(C("severity").isin(*block_on).cast("long"))
    out = df.agg(F.count(F.lit(1)).alias("total"), F.coalesce(blocking, F.lit(0)).alias("blocking"), *[F.coalesce(n("severity", s), F.lit(0)).alias(s) for s in ("critical", "high", "medium")], *[F.coalesce(n("type", t), F.lit(0)).alias(t) for t in ("security", "type_coverage", "dependency_upgrade")])
    risk = F.when(C("critical") > 0, "critical").when(C("high") > 0, "high").when(C("medium") > 0, "medium").when(C("total") > 0, "low").otherwise("none")
    label = F.array_compact(F.array(F.when(C("blocking") > 0, "needs-fix"), F.when(C("security") > 0, "security-risk"), F.when(C("type_coverage") > 0, "type-issues"), F.when(C("dependency_upgrade") > 0, "dependency-upgrade")))
    return out.select("total", "blocking", risk.alias("risk"), F.when(C("blocking") > 0, "changes-requested").otherwise("approved-with-notes").alias("status"), F.array_join(label, ",").alias("labels"))


def run_savings(df: DataFrame, rate: float = 85.0) -> DataFrame:
    """Hours saved over all findings before dedup (AGG-8)."""
    out = df.agg(F.sum(dims.pick("type", dims.EFFORT_HOURS, 1.0)).alias("manual_hours"), F.count(F.lit(1)).alias("n"))
    saved = F.greatest(C("manual_hours") - C("n") * 5.0 / 60.0, F.lit(0.0))
    return out.select(F.round("manual_hours", 2).alias("manual_hours"), F.round(C("n") * 5.0 / 60.0, 2).alias("automated_hours"), F.round(saved, 2).alias("hours_saved"), F.round(saved * rate, 1).alias("savings_usd"))


def roi_report(df: DataFrame, rate: float = 75.0) -> DataFrame:
    """Costs, hours of successful fixes, savings and return of each period (AGG-9)."""
    cost = C("ai_cost") + C("infra_cost") + C("setup_cost")
    ok = C("was_successful")
    out = df.groupBy("period").agg(
        F.sum(cost).alias("cost"), F.coalesce(F.sum(F.when(ok, C("manual_hours") * C("automation_rate"))), F.lit(0.0)).alias("hours"), F.count(F.lit(1)).alias("fixes"), F.sum(ok.cast("long")).alias("successful"), F.avg("automation_rate").alias("automation")
    )
    savings = C("hours") * rate
    return out.select(
        "period",
        F.round("cost", 4).alias("cost"),
        F.round("hours", 2).alias("hours"),
        "fixes",
        "successful",
        F.round(F.when(C("successful") > 0, C("cost") / F.nullif(C("successful"), F.lit(0))).otherwise(0.0), 4).alias("cost_per_fix"),
        F.round(savings, 1).alias("savings"),
        F.round(F.when(C("cost") > 0, (savings - C("cost")) / F.nullif(C("cost"), F.lit(0.0)) * 100).otherwise(0.0), 1).alias("net_roi_pct"),
        F.round(F.when((savings > C("cost")) & (C("cost") > 0), C("cost") / F.greatest(savings - C("cost"), F.lit(0.0001))).otherwise(0.0), 4).alias("payback_months"),
        F.round("automation", 4).alias("automation"),
    )


def roi_by_type(df: DataFrame, rate: float = 75.0) -> DataFrame:
    """Cost, hours, count and savings of each finding type, failures included (AGG-9)."""
    hours = C("manual_hours") * C("automation_rate")
    kind = F.coalesce(F.nullif(C("finding_type"), F.lit("")), F.lit("unknown")).alias("finding_type")
    return df.groupBy(kind).agg(F.round(F.sum(C("ai_cost") + C("infra_cost") + C("setup_cost")), 3).alias("cost"), F.round(F.sum(hours), 2).alias("hours"), F.count(F.lit(1)).alias("n"), F.round(F.sum(hours) * rate, 1).alias("savings"))


def unpivoted(df: DataFrame, key: str) -> DataFrame:
    """(section, key, value) rows (SNK-5)."""
    values = [c for c in df.columns if c != key]
    return df.select(F.concat(F.lit("finding_type:"), C(key)).alias("section"), *[C(v).cast("double").alias(v) for v in values]).unpivot("section", values, "key", "value")


def period_change(df: DataFrame) -> DataFrame:
    """Each period's totals less those of the one before (AGG-10)."""
    per = df.groupBy("period").agg(F.sum(C("ai_cost") + C("infra_cost") + C("setup_cost")).alias("cost"), F.count(F.lit(1)).alias("fixes"))
    w = Window.orderBy("period")
    return per.select("period", F.round(C("cost") - F.lag("cost").over(w), 3).alias("cost_change"), (C("fixes") - F.lag("fixes").over(w)).alias("fixes_change"))


def budget(df: DataFrame, limit: float, day: int, days: int) -> DataFrame:
    """Spending, what remains, cost per pull request and the month's projection (AGG-12, AGG-14)."""
    out = df.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"), F.count(F.lit(1)).alias("entries"), F.sum((C("operation") == "create_pr").cast("long")).alias("prs"))
    return out.select(
        F.round("spent", 3).alias("spent"), F.round(F.greatest(limit - C("spent"), F.lit(0.0)), 3).alias("remaining"), F.round(C("spent") / limit * 100, 3).alias("usage_pct"), "entries", F.round(C("spent") / F.greatest(C("prs"), F.lit(1)), 4).alias("cost_per_pr"), F.round(C("spent") / day * days, 2).alias("projected")
    )


def operation_counts(df: DataFrame) -> DataFrame:
    """Entries of each operation (AGG-13)."""
    return df.filter("operation <> ''").groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def budget_alerts(df: DataFrame, limit: float, thresholds: tuple[int, ...] = (50, 80, 90, 100)) -> DataFrame:
    """Thresholds that spending has reached (AGG-15)."""
    spent = df.agg((F.coalesce(F.sum("cost_usd"), F.lit(0.0)) / limit * 100).alias("usage"))
    return spent.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "usage").filter("usage >= threshold").select("threshold")


def running_spend(df: DataFrame, limit: float) -> DataFrame:
    """Running total of each team in ledger order and whether it is past the limit (AGG-17)."""
    return running.running(df, ["team"], [F.asc("seq")], C("cost_usd"), "running").drop("running_all").withColumn("past_limit", C("running") > limit)


def crossings(df: DataFrame, limit: float, thresholds: tuple[int, ...] = (50, 80, 90, 100)) -> DataFrame:
    """The first entry at which a team's total reaches each threshold (AGG-16)."""
    at = running_spend(df, limit).select("team", "seq", "running", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return at.filter(C("running") / limit * 100 >= C("threshold")).groupBy("team", "threshold").agg(F.min("seq").alias("seq"))


def sla_report(df: DataFrame) -> DataFrame:
    """Runs, durations with the 95th of a hundred, pull requests and an alert for each team (AGG-18, AGG-6)."""
    rows = running.placed(df, ["team"], [F.asc("duration_seconds"), F.asc("seq")]).withColumnRenamed("place_all", "n")
    p95 = F.max(F.when(C("place") == F.least(F.floor(C("n") * F.lit(0.95)), C("n") - 1) + 1, C("duration_seconds")))
    ok = C("success").cast("long")
    out = rows.groupBy("team").agg(
        F.count(F.lit(1)).alias("total"), F.sum(ok).alias("successful"), F.avg("duration_seconds").alias("avg_duration"), p95.alias("p95"), F.avg(F.when(C("prs_created") > 0, C("duration_seconds"))).alias("to_pr"), F.sum("findings_count").alias("findings"), F.sum("prs_created").alias("prs"), F.min("timestamp").alias("period_start"), F.max("timestamp").alias("period_end")
    )
    failed_pct = (C("total") - C("successful")) / C("total") * 100
    return out.select(
        "team", "total", "successful", F.round(100.0 * C("successful") / C("total"), 3).alias("success_rate"), F.round("avg_duration", 3).alias("avg_duration"), F.round("p95", 4).alias("p95"), F.round(F.coalesce("to_pr", F.lit(0.0)), 3).alias("to_pr"), "findings", "prs", "period_start", "period_end", (failed_pct > 10).alias("alert")
    )


def failure_reasons(df: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent failure reasons, cut to 80 characters (AGG-18)."""
    return hotspots(df.filter("failure_reason <> ''").withColumn("reason", F.substring("failure_reason", 1, 80)), "reason", k)


def failure_trend(df: DataFrame) -> DataFrame:
    """Failure rates of the older and the newer half of a team's runs (AGG-19)."""
    rows = running.placed(df, ["team"], [F.asc("timestamp"), F.asc("seq")], "rn").withColumnRenamed("rn_all", "n")
    old = C("rn") <= F.floor(C("n") / 2)
    fail = (~C("success")).cast("double")
    out = rows.groupBy("team").agg(F.max("n").alias("n"), F.avg(F.when(old, fail)).alias("older"), F.avg(F.when(~old, fail)).alias("newer"))
    trend = F.when(C("n") < 4, "stable").when(C("newer") < C("older") - 0.1, "improving").when(C("newer") > C("older") + 0.1, "degrading").otherwise("stable")
    return out.select("team", trend.alias("trend"), F.round("older", 5).alias("older"), F.round("newer", 5).alias("newer"))


def last_runs(df: DataFrame, k: int = 20) -> DataFrame:
    """The newest runs (SRT-6)."""
    return df.orderBy(F.desc("timestamp"), F.desc("seq")).limit(k)


def success_rates(df: DataFrame, by: str) -> DataFrame:
    """Merged among decided, 1 where nothing is decided (AGG-21 to AGG-23), and the confidence to add (AGG-24)."""
    decided = C("status") != "pending"
    out = df.groupBy(by).agg(F.coalesce(F.avg(F.when(decided, (C("status") == "merged").cast("double"))), F.lit(1.0)).alias("rate"), F.sum(decided.cast("long")).alias("decided"))
    more = F.when(C("rate") >= 0.9, 0).otherwise(F.greatest(F.lit(1), F.floor(10 * (0.9 - C("rate"))).cast("int")))
    return out.select(by, F.round("rate", 6).alias("rate"), "decided", more.cast("int").alias("adjustment"))


def learning_summary(df: DataFrame) -> DataFrame:
    """Outcomes and accuracy over completed ones (AGG-25)."""
    out = df.agg(F.count(F.lit(1)).alias("total"), *[F.sum((C("status") == s).cast("long")).alias(s) for s in ("merged", "rejected", "pending")])
    done = C("merged") + C("rejected")
    return out.withColumn("accuracy", F.round(F.when(done > 0, C("merged") / F.nullif(done, F.lit(0))).otherwise(0.0), 6))


def feedback_accuracy(df: DataFrame) -> DataFrame:
    """Accepted among all rows (AGG-26)."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum((C("action") == "accepted").cast("long")).alias("accepted"), F.round(F.avg((C("action") == "accepted").cast("double")), 6).alias("accuracy"))


def history_rates(df: DataFrame) -> DataFrame:
    """Success rate of each finding type (AGG-27, AGG-28)."""
    return df.groupBy("finding_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("team").alias("teams"), F.round(F.avg(C("success").cast("double")), 6).alias("rate"))


def preference_summary(df: DataFrame) -> DataFrame:
    """Preferences, teams and users of each category (AGG-29)."""
    some = lambda c: F.count_distinct(F.nullif(C(c), F.lit("")))
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), some("team").alias("teams"), some("usr").alias("users"))


def store_trends(df: DataFrame) -> DataFrame:
    """Total, resolved and active (AGG-30)."""
    gone = F.sum(C("resolved").cast("long"))
    return df.agg(F.count(F.lit(1)).alias("total"), gone.alias("resolved"), (F.count(F.lit(1)) - gone).alias("active"))


def usage(df: DataFrame, most: float) -> DataFrame:
    """Tokens, requests and cost of each period, and whether they pass a limit (AGG-38)."""
    return df.groupBy("period", "team").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count(F.lit(1)).alias("requests"), F.round(F.sum("cost_usd"), 3).alias("cost"), (F.sum("cost_usd") > most).alias("past_limit"))


def all_passed(df: DataFrame, by: str, failed: str) -> DataFrame:
    """Groups without a failed row (AGG-34, AGG-35)."""
    return df.groupBy(by).agg(F.bool_and(~F.expr(failed)).alias("passed"), F.count(F.lit(1)).alias("n")).withColumn("action", F.when(C("passed"), "proceed").otherwise("abort"))
