"""Questions asked of syntax facts: who reaches a function, who calls it, who tests it, what it looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, ranking

C = F.col


def definitions(facts: DataFrame) -> DataFrame:
    """One row for each function name: what the last definition says, and where the first one stands."""
    place = F.struct("path", "place")
    data = F.struct("path", "line", "end_line", "entry", "place")
    return facts.filter("kind = 'function'").groupBy("name").agg(F.max_by(data, place).alias("d"), F.min(place).alias("first")).select("name", "d.*", "first")


def reachable_functions(facts: DataFrame) -> DataFrame:
    """Functions by name, with the chain of calls from the nearest entry point, null where there is none (DET-7).

    Calls are matched by bare name with the last definition of that name.
    """
    defs = graph.cut(definitions(facts))
    called = facts.filter("kind = 'calls'").select(C("path").alias("c_path"), C("place").alias("c_place"), "owner", C("name").alias("dst"))
    last = called.join(defs.select(C("name").alias("owner"), C("path").alias("c_path"), C("place").alias("c_place")), ["owner", "c_path", "c_place"], "left_semi")
    edges = graph.cut(last.join(defs.select(C("name").alias("dst")), "dst", "left_semi").select(C("owner").alias("src"), "dst").distinct())
    chains = graph.nearest_paths(edges, defs.filter("entry").select(C("name").alias("node")))
    return defs.join(chains.select(C("node").alias("name"), C("path").alias("call_chain")), "name", "left")


def with_reachability(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings (seq, file, line, priority_score) with their enclosing function and, if it is reachable, chain and raised priority (DET-7).

    Outside of functions and of Python files the three new columns are null and the priority stays.
    """
    f = reachable_functions(facts).select(C("path").alias("f_path"), C("line").alias("f_line"), "end_line", "first", "name", "call_chain")
    met = findings.filter(F.endswith("file", F.lit(".py"))).select("seq", "file", C("line").alias("at")).join(f, (C("file") == C("f_path")) & C("at").between(C("f_line"), C("end_line")))
    inner = met.groupBy("seq").agg(F.min_by(F.struct("name", "call_chain"), "first").alias("f"))
    rows = findings.join(inner, "seq", "left").select(*findings.columns, C("f.name").alias("enclosing"), C("f.call_chain").alias("call_chain"), F.when(C("f").isNotNull(), C("f.call_chain").isNotNull()).alias("reachable"))
    return rows.withColumn("priority_score", F.when(C("reachable"), F.least(F.lit(200.0), C("priority_score") * 1.1)).otherwise(C("priority_score")))


def framework_entries(facts: DataFrame) -> DataFrame:
    """Modules with a way in, its kind and detail (DET-42, DET-43, GR-5)."""
    return facts.filter("kind = 'entry_point'").select("path", C("name").alias("framework"), "detail")


def reaching_framework(edges: DataFrame, entries: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (seq, node) with how many entry points reach their module and the framework of the first of these (GR-8).

    entries: node, framework and ``place``, which orders them.
    """
    found = graph.spread(edges, entries.select(C("place"), "node", F.lit(0).alias("value")), ("place",))
    frameworks = entries.select("place", "framework")
    first = found.join(frameworks, "place").groupBy("node").agg(F.min_by("framework", "place").alias("framework"), F.count(F.lit(1)).alias("entry_points"))
    met = findings.join(first, "node", "left")
    return met.withColumn("reachable", C("framework").isNotNull()).withColumn("framework", F.coalesce("framework", F.lit("unknown"))).withColumn("entry_points", F.coalesce("entry_points", F.lit(0)))


def call_sites(facts: DataFrame, names: list[str], k: int = 50) -> DataFrame:
    """Where the named functions are called: the first ``k`` places of each and the number of all (JOIN-11)."""
    rows = facts.filter((C("kind") == "call_site") & C("name").isin(names)).select("name", "path", "line")
    n = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_k(rows, k, F.asc("path"), F.asc("line"), by=["name"]).join(F.broadcast(n), "name")


def function_lines(facts: DataFrame, files: DataFrame, context: int = 0) -> DataFrame:
    """Lines of every function, and as many around them as ``context`` says, from line ``start`` on."""
    f = facts.filter("kind = 'function'").select("path", "name", "line", "end_line", "place")
    rows = f.join(files.select("path", F.split(F.regexp_replace("text", r"\n\z", ""), "\n").alias("all_lines")), "path").withColumn("start", F.greatest(F.lit(1), C("line") - context))
    return rows.withColumn("lines", F.slice("all_lines", C("start"), C("end_line") + context - C("start") + 1)).drop("all_lines")


def covering_tests(facts: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """Test functions of test files whose source holds one of the names (JOIN-12)."""
    tests = facts.filter(C("path").rlike(r"(^|/)test_[^/]*\.py$") & (C("kind") == "function") & F.startswith("name", F.lit("test_")))
    body = F.array_join("lines", "\n")
    met = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(body, n))
    return function_lines(tests, files).select("path", C("name").alias("test"), F.explode(met).alias("name")).distinct()


def numbered_source(facts: DataFrame, files: DataFrame, context: int = 5) -> DataFrame:
    """Numbered listing of each function with lines around it; of equal names in a file the outermost, then first, counts (TXT-27)."""
    first = facts.filter("kind = 'function'").groupBy("path", "name").agg(F.min_by(F.struct("line", "end_line"), "place").alias("f"), F.lit("function").alias("kind"), F.min("place").alias("place"))
    rows = function_lines(first.select("path", "name", "kind", "place", "f.*"), files, context)
    listing = F.transform("lines", lambda x, i: F.format_string("%4d | %s", C("start") + i, x))
    return rows.select("path", "name", F.array_join(listing, "\n").alias("listing"))


def type_hints(facts: DataFrame) -> DataFrame:
    """Return type and parameters of each function, null where there is no hint (TXT-29)."""
    shape = "returns string, parameters array<struct<name:string,hint:string>>"
    return facts.filter("kind = 'function'").select("path", "name", "line", F.from_json("detail", shape).alias("h")).select("path", "name", "line", "h.*")


def missing_imports(facts: DataFrame, available: DataFrame) -> DataFrame:
    """Absolute imports whose top-level package isn't in ``available`` (module), each once for a file (TXT-26)."""
    rows = facts.filter("kind = 'import'").select("path", "name", F.substring_index("name", ".", 1).alias("module")).distinct()
    return rows.join(available.select("module").distinct(), "module", "left_anti").select("path", "name")


def prompt_list(rows: DataFrame, by: str, order: str, text: str, title: str, k: int | None = None) -> DataFrame:
    """A title and the numbered texts of each group in their order, the first ``k`` if set (TXT-19, TXT-20)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    some = rows.filter(C(text).isNotNull()).withColumn("n", n)
    some = some.filter(C("n") <= k) if k else some
    item = F.concat(F.lit("  "), C("n").cast("string"), F.lit(". "), C(text))
    items = F.transform(F.sort_array(F.collect_list(F.struct("n", item.alias("item")))), lambda x: x["item"])
    return some.groupBy(by).agg(F.concat(F.lit(title + "\n"), F.array_join(items, "\n")).alias("prompt"))
