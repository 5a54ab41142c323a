"""Dedup, order, batches and top-k.  Order always ends in ``seq``, so ties keep their first-seen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from . import graph, matching

C = F.col


def dedup_key() -> Column:
    """The first 16 hex digits of sha256 over type, file, line and description (SET-3)."""
    return F.substring(F.sha2(F.concat_ws(":", "type", "file", C("line").cast("string"), "description"), 256), 1, 16)


def first_of(df: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The first row of each key (SET-2): a min over a struct, combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), C(order)).alias("row")).select(*keys, "row.*")


def last_of(df: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The last row of each key: replay of an append-only log (STM-4)."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), C(order)).alias("row")).select(*keys, "row.*")


def unseen(df: DataFrame, seen: DataFrame, key: str = "dedup_key") -> DataFrame:
    """First rows of keys that a store hasn't seen (JOIN-5)."""
    return first_of(df, key).join(seen.select(key), key, "left_anti")


def prioritised(df: DataFrame) -> DataFrame:
    """Position by priority plus impact, best first, stable (SRT-1).

    Positions need a total order: rows are range-sorted, counted by partition and numbered inside.
    """
    return numbered(df.withColumn("score", C("priority_score") + C("business_impact_score")), [F.desc("score"), F.asc("seq")])


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add 1-based positions in a total order without bringing all rows into one task.

    The sorted rows are written once with the partition they lie in: a second run of the sort could draw
    other bounds, and counts and rows must speak of the same partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ordered = graph.cut(ordered)
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.join(F.broadcast(counts.withColumn("_before", before)), "_part").withColumn(name, C("_before") + C("_row") - C("_first") + 1).drop("_part", "_row", "_n", "_first", "_before")


def work_order_key() -> Column:
    """Severity rank plus type bonus (SRT-2)."""
    return dims.pick("severity", dims.SEVERITY_RANK, 5) + dims.pick("type", dims.TYPE_BONUS, 5)


def folder() -> Column:
    return F.when(C("file").contains("/"), F.regexp_extract("file", r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def reference_lines(lines: DataFrame, symbol: str, k: int = 50) -> DataFrame:
    """The first ``k`` lines that name a symbol, trimmed, and how many do (JOIN-10).  lines: path, line_no, text and what else orders them."""
    held = lines.filter(F.contains("text", F.lit(symbol)))
    others = [c for c in lines.columns if c not in ("path", "line_no", "text")]
    first = top_k(held.withColumn("text", F.trim("text")), k, F.asc("path"), F.asc("line_no"), *map(F.asc, others))
    return first.withColumn("total", held.agg(F.count(F.lit(1))).scalar())


def batches(df: DataFrame, max_files: int = 5, max_prs: int = 5, auto_split: bool = True) -> DataFrame:
    """Findings in batches of one folder each, folders in first-seen order, the first ``max_prs`` batches (SRT-3).

    Without ``auto_split`` the first ``max_prs`` findings are one batch.
    """
    if not auto_split:
        return top_k(df, max_prs, F.asc("seq")).withColumn("batch", F.lit(1))
    rows = df.withColumn("folder", folder())
    firsts = rows.groupBy("folder").agg(F.min("seq").alias("folder_first"))
    rows = rows.join(firsts, "folder").withColumn("rn", F.row_number().over(Window.partitionBy("folder").orderBy("seq"))).withColumn("part", F.floor((C("rn") - 1) / max_files))
    heads = rows.select("folder_first", "folder", "part").distinct().orderBy("folder_first", "part").limit(max_prs)
    heads = heads.withColumn("batch", F.row_number().over(Window.orderBy("folder_first", "part")))
    return rows.join(F.broadcast(heads), ["folder_first", "folder", "part"])


def top_k(df: DataFrame, k: int, *order: Column, by: list[str] | None = None) -> DataFrame:
    """The first k rows, of all or of each group."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(C("rank") <= k)


def best_alternative(df: DataFrame) -> DataFrame:
    """For each finding the alternative of highest confidence, then fewest changes (SRT-4)."""
    return top_k(df, 1, F.desc("confidence"), F.asc("n_changes"), F.asc("seq"), by=["finding"]).drop("rank")


def merged_preferences(df: DataFrame, team: str, user: str, limit: int = 20) -> DataFrame:
    """A user's preferences before the team's, each text once, newest first (SRT-5)."""
    mine = df.filter((C("team") == team) & ((C("usr") == user) | (C("usr") == ""))).withColumn("is_user", (C("usr") == user).cast("int"))
    kept = mine.withColumn("rn", F.row_number().over(Window.partitionBy("preference").orderBy(F.desc("is_user"), "seq"))).filter("rn = 1")
    return kept.orderBy(F.desc("timestamp"), "seq").limit(limit)


def insert_absent(new: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in the store yet, each once (SET-6)."""
    return first_of(new, *keys).join(store.select(*keys).distinct(), keys, "left_anti")


def similar_history(findings: DataFrame, history: DataFrame, k: int = 5) -> DataFrame:
    """For each finding the k best past rows of its type (JOIN-8).

    What scores equally is one case: for each (type, library, pattern, file pattern) only the first k
    rows can be among a finding's best, so a case holds these in an array.  Findings are reduced in
    the same way, to their distinct profiles, before they meet the cases; the k best rows of each
    profile are then joined back to its findings.
    """
    kind = ["finding_type", F.lower("library").alias("h_library"), F.lower("pattern").alias("h_pattern"), "file_pattern"]
    first = F.row_number().over(Window.partitionBy("finding_type", "h_library", "h_pattern", "file_pattern").orderBy("seq"))
    cases = history.select(*kind, "seq").withColumn("n", first).filter(C("n") <= k).groupBy("finding_type", "h_library", "h_pattern", "file_pattern").agg(F.sort_array(F.collect_list("seq")).alias("rows"))
    profile = ["type", "p_library", "p_pattern", "p_folder"]
    mine = findings.withColumn("p_library", F.lower("library")).withColumn("p_pattern", F.lower("pattern")).withColumn("p_folder", folder())
    score = F.lit(1.0) + F.when(C("p_library") == C("h_library"), 2.0).otherwise(0.0)
    score = score + F.when((C("p_pattern") != "") & F.contains("h_pattern", "p_pattern"), 1.5).otherwise(0.0) + F.when(F.contains("p_folder", "file_pattern"), 0.5).otherwise(0.0)
    met = mine.select(*profile).distinct().join(cases, C("type") == C("finding_type")).withColumn("match_score", score)
    best = top_k(met.select(*profile, "match_score", F.explode("rows").alias("hseq")), k, F.desc("match_score"), F.asc("hseq"), by=profile)
    lists = best.groupBy(*profile).agg(F.sort_array(F.collect_list(F.struct("rank", "hseq", "match_score"))).alias("best"))
    return mine.join(lists, profile).select(*findings.columns, F.inline("best"))


def enclosing_function(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """The first listed function of the same file whose lines hold the finding (DET-8, JOIN-6).

    Each place (file, line) is answered once, by the order of its first function, then named and given to its findings.
    """
    f = functions.select("file", C("name").alias("function"), "start_line", "end_line", C("seq").alias("fseq"))
    places = matching.first_within(findings.select("file", "line"), f, ["file"], "line", "start_line", "end_line", "fseq")
    held = C("line").between(C("start_line"), C("end_line"))
    named = places.join(f.withColumnsRenamed({"file": "f_file", "fseq": "f_fseq"}), (C("file") == C("f_file")) & (C("fseq") == C("f_fseq")) & held, "left")
    named = named.groupBy("file", "line", "fseq", "n_holding").agg(F.min("function").alias("function"))
    met = findings.select("seq", "file", "line").join(named, ["file", "line"])
    return met.groupBy("seq").agg(F.min_by("function", "fseq").alias("function"), F.sum("n_holding").alias("n_holding"))
