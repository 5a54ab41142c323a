"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets word, symbol, line and repetition counts, and a failure flag for every rule.
Failures are added up by host.  Host failure rates are shrunk towards a beta prior that is itself
estimated from all hosts (method of moments), and the verdict on the host is joined back.

Defined results: a null text has no words, so it fails the base rule; a null host is a host of its
own; repeated rows are separate documents; a host with one document is judged by the prior almost
alone; an empty table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]"
#: A host is rejected when the shrunk rate of its documents that fail a rule exceeds this.
HOST_RATE = 0.6


def repeated_words(words: str) -> Column:
    """Words inside 3-word windows that occur twice or more, as an SQL expression over an array column.

    A window's hash and its place share one long: the low bits hold the place, the high bits the
    hash.  Sorting these longs brings equal windows together; neighbours are compared word by word.
    """
    place = lambda x: f"cast({x} & m.low AS int)"
    now, before = place("p[i]"), place("p[i - 1]")
    equal = " AND ".join(f"{words}[{now} + {k}] = {words}[{before} + {k}]" for k in range(3))
    near = f"filter(sequence(1, size(p) - 1), i -> shiftright(p[i], m.bits) = shiftright(p[i - 1], m.bits) AND {equal})"
    spread = f"flatten(transform({near}, i -> array({now}, {now} + 1, {now} + 2, {before}, {before} + 1, {before} + 2)))"
    packed = f"sort_array(transform(sequence(0, size({words}) - 3), i -> shiftleft(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), m.bits) + i))"
    bits = f"length(bin(size({words})))"
    # transform over an array of one binds a value, so that it is computed once and not for every element
    bound = f"transform(array(struct({bits} AS bits, shiftleft(1L, {bits}) - 1 AS low)), m -> transform(array({packed}), p -> size(array_distinct({spread})))[0])[0]"
    return F.expr(f"CASE WHEN size({words}) < 4 THEN 0L ELSE cast({bound} AS long) END")


def features(docs: DataFrame, host: str = "source", *more: str) -> DataFrame:
    """Counts over the whole text of every document, beside its id, its host and the columns ``more``."""
    base = common.columns(docs, "doc_id", "text", host, *more).select(*more, "doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("words", F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    lines = F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    return base.select(
        *more,
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeated_words("words").alias("n_repeat_words"),
    )


def judge(counts: DataFrame) -> DataFrame:
    """Base rule and further rules, one flag each, and whether any fails."""
    return (
        counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("symbols_failed", 20 * F.col("n_symbols") > F.col("word_chars"))
        .withColumn("lines_failed", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
        .withColumn("length_failed", (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")))
        .withColumn("failed", F.col("base_failed") | F.col("symbols_failed") | F.col("lines_failed") | F.col("length_failed"))
    )


def hosts(judged: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """Documents, failures, the shrunk failure rate and the verdict of each host.

    The prior's mean is the mean rate of the hosts; its weight follows from how much the rates
    vary beyond what binomial counts alone would give.
    """
    per = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("failed", "base_failed", "symbols_failed", "lines_failed", "length_failed")])
    raw = F.col("failed") / F.col("n")
    prior = per.agg(
        F.coalesce(F.avg(raw), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(raw), F.lit(0.0)).alias("spread"), F.coalesce(F.avg(1.0 / F.col("n")), F.lit(1.0)).alias("per_n")
    )
    binomial = F.col("mean") * (1 - F.col("mean"))
    excess = F.greatest(F.col("spread") - binomial * F.col("per_n"), F.lit(1e-6))
    weight = F.greatest(F.least(binomial / excess - 1, F.lit(1000.0)), F.lit(2.0))
    shrunk = (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return per.crossJoin(F.broadcast(prior.withColumn("weight", weight))).withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > rate)


def score(docs: DataFrame, host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """Every document with its counts, flags, host rate and ``kept``.

    The counts are written once to the shared folder.  Hosts are joined by broadcast behind a count
    of them, else by a shuffle on host and a salt, so that no host lands in one task.
    """
    judged = common.keep(judge(features(docs, host)), "quality")
    verdicts = common.keep(hosts(judged, rate).select(F.col("host").alias("verdict_host"), "host_rate", "host_rejected"), "hosts")
    same = F.col("host").eqNullSafe(F.col("verdict_host"))
    if verdicts.count() <= common.BROADCAST_ROWS:
        out = judged.join(F.broadcast(verdicts), same, "left")
    else:
        salts = 16
        salted = verdicts.withColumn("verdict_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(salts)).cast("int")).join(salted, same & (F.col("salt") == F.col("verdict_salt")), "left")
    return out.withColumn("kept", ~F.col("failed") & ~F.col("host_rejected"))


def filter_documents(docs: DataFrame, host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """The documents that stay, with the columns of ``docs``: counts are made once, beside the whole rows."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    counts = features(whole.select("row", "row.doc_id", "row.text", F.col(f"row.`{host}`").alias(host)), host, "row")
    judged = common.keep(judge(counts), "quality")
    bad = common.keep(hosts(judged, rate).filter("host_rejected").select(F.col("host").alias("verdict_host")), "hosts")
    kept = judged.filter(~F.col("failed"))
    rows = bad.count()
    if rows:
        kept = kept.join(F.broadcast(bad) if rows <= common.BROADCAST_ROWS else bad, F.col("host").eqNullSafe(F.col("verdict_host")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
