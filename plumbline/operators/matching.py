"""Joins by substring, by ending and by interval, as equality joins on an index.

Each condition is turned into keys that both sides can compute: character grams, endings, bins.  So rows meet by
a shuffle on keys, which Spark may split, and not each with each; what a key lets through is then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Characters of a gram; shorter needles are looked up among grams of their own length.
GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    some = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """The pairs of ``text`` and ``needle`` where the text holds the needle; distinct, without nulls and empty needles (SET-7, JOIN-9).

    Texts are indexed by all their grams.  A needle probes with one gram alone, the one that fewest texts hold, so a
    common gram is met only by needles that have no rarer one.
    """
    texts, needles = texts.select("text").distinct(), needles.select("needle").filter("needle <> ''").distinct()
    index = texts.select("text", F.explode(F.array_union(grams(C("text"), 1), F.array_union(grams(C("text"), 2), grams(C("text"), GRAM)))).alias("gram"))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    probes = needles.select("needle", F.explode(F.when(F.length("needle") >= GRAM, grams(C("needle"), GRAM)).otherwise(F.array("needle"))).alias("gram"))
    # a needle with a gram that no text holds is in no text
    rated = probes.join(held, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).filter("least.n > 0")
    met = rated.select("needle", C("least.gram").alias("gram")).join(index, "gram")
    return met.filter(F.contains("text", "needle")).select("text", "needle")


def ending(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs of ``text`` and ``needle`` where the text ends with the needle; distinct, without nulls and empty needles.

    A text is indexed by its endings of those lengths that needles have.
    """
    texts, ends = texts.select("text").distinct(), ends.select("needle").filter("needle <> ''").distinct()
    lengths = ends.agg(F.collect_set(F.length("needle")).alias("lengths"))  # as many as there are lengths of paths
    index = texts.withColumn("lengths", lengths.scalar()).select("text", F.explode(F.filter("lengths", lambda n: n <= F.length("text"))).alias("n"))
    return index.select("text", F.right("text", C("n")).alias("needle")).join(ends, "needle").select("text", "needle")


def ending_either_way(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of ``text`` (of a) and ``needle`` (of b) where one ends with the other (FIL-8)."""
    back = ending(b.select(C("needle").alias("text")), a.select(C("text").alias("needle"))).select(C("needle").alias("text"), C("text").alias("needle"))
    return ending(a, b).unionByName(back).distinct()


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """Points (keys, ``at``) with the spans (keys, ``first``, ``last``) that hold them (JOIN-6).

    A span lies in at most two bins of the least power of two that is not shorter than it; a point looks into its bin
    of each such size that spans have, 63 at most.  So long and short spans are told apart, and a file with very many is
    cut to bins.
    """
    size = F.ceil(F.log2(F.greatest(C(last) - C(first) + 1, F.lit(1)).cast("double"))).cast("int")
    bins = spans.filter(C(last) >= C(first)).withColumn("_size", size)
    sizes = bins.agg(F.collect_set("_size").alias("sizes")).scalar()
    bins = bins.withColumn("_bin", F.explode(F.sequence(F.expr(f"shiftright(cast({first} AS long), _size)"), F.expr(f"shiftright(cast({last} AS long), _size)"))))
    probes = points.withColumn("_size", F.explode(sizes)).withColumn("_bin", F.expr(f"shiftright(cast({at} AS long), _size)"))
    return probes.join(bins, [*keys, "_size", "_bin"]).filter(C(at).between(C(first), C(last))).drop("_size", "_bin")


def first_within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, last: str, order: str) -> DataFrame:
    """The distinct points (keys, ``at``) that spans hold, with the least ``order`` of these and how many they are, ``n_holding``.

    No pair is made.  A span is the sum of at most two aligned bins of each power of two; spans are counted by bin, and
    a point adds up the bins that it lies in, one of each size, 63 at most.  So the rows grow with points and spans,
    however many of them meet.
    """
    ends = [C(first).cast("long").alias("_from"), (C(last).cast("long") + 1).alias("_to")]
    levels = F.length(F.bin(C("_to") - C("_from"))) - 1
    whole = spans.filter(C(last) >= C(first)).select(*keys, *ends, order)
    top = whole.agg(F.max(levels)).scalar()
    same = whole.groupBy(*keys, "_from", "_to").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("_n"))
    low, high = F.expr("-shiftright(-_from, _size)"), F.expr("shiftright(_to, _size)")  # the bins of a size inside the span, the end excluded
    parts = F.array(F.when((low < high) & (low % 2 != 0), low), F.when((low < high) & (high % 2 != 0), high - 1))
    parts = same.withColumn("_size", F.explode(F.sequence(F.lit(0), levels))).withColumn("_bin", F.explode(parts)).filter("_bin IS NOT NULL")
    index = parts.groupBy(*keys, "_size", "_bin").agg(F.min(order).alias(order), F.sum("_n").alias("_n"))
    probes = points.select(*keys, at).distinct().withColumn("_size", F.explode(F.sequence(F.lit(0), top))).withColumn("_bin", F.expr(f"shiftright(cast({at} AS long), _size)"))
    return probes.join(index, [*keys, "_size", "_bin"]).groupBy(*keys, at).agg(F.min(order).alias(order), F.sum("_n").alias("n_holding"))
