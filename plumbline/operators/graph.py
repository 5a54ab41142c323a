"""Reachability, impact, cycles and cascades over edges.

One loop, ``spread``, carries values along edges until nothing improves.  It works on the nodes that changed in
the round before, and from the third round on also along shortcuts: chains of least neighbours and chains of
greatest neighbours, whose lengths double in each round.  So a chain of any length takes rounds in the logarithm of it,
and other paths as many as they change between the two.  Nodes hold a value, no path; paths are rebuilt for the
targets that ask for them, from a table of parents and its doubled ancestors.  Every round is one written table, whose
rows are counted while it is written.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

C = F.col
#: Rounds along plain edges before shortcuts are made.
PLAIN = 3
#: Colours of each node in a pass of the component search.
COLOURINGS = 3
#: Edges of a block that one task solves, and least number of blocks.
BLOCK, BLOCKS = 500_000, 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset, in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))
    return (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> int:
    """Write a table and count its rows on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """A table written to the shared folder and read again, with its number of rows: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession)
    n = written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), n


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(C("dst").alias("src"), C("src").alias("dst"))


def way_schema(edges: DataFrame, on: tuple[str, ...]) -> str:
    kind = dict(edges.dtypes)
    return ", ".join(f"{c} {kind[c]}" for c in (*on, "src", "dst")) + ", length long, kind int, step int"


def onward(ways: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """For every node the edge to its least neighbour and, as another kind, to its greatest."""
    both = ways.groupBy(*on, "src").agg(F.min("dst").alias("low"), F.max("dst").alias("high"), F.min("length").alias("length"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), C("low").alias("dst")), F.struct(F.lit(1).alias("kind"), C("high").alias("dst")))
    return both.select(*on, "src", "length", F.inline(kinds)).select(*on, "src", "dst", "length", "kind")


def spread(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = (), length: int = 1, most: bool = False, hops: int | None = None, limit: int | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """The least (``most``: greatest) value of every node, for each of ``keys``: those of ``starts`` (keys, node, value) plus ``length`` an edge.

    ``on`` are those of the keys that edges have too: they lead on within their own key.  ``hops`` stops after so many edges; a value beyond ``limit`` is an error, since only a cycle can give one.
    """
    by, pick = [*keys, "node"], F.max if most else F.min
    spark, folder = edges.sparkSession, new_folder(edges.sparkSession)
    ways = lambda: spark.read.schema(way_schema(edges, on)).parquet(folder)
    first = edges.select(*on, "src", "dst").distinct().select(*on, "src", "dst", F.lit(length).cast("long").alias("length"), F.lit(0).alias("kind"))
    first.write.parquet(f"{folder}/step=0")
    state, n = changes(starts.select(*by, C("value").cast("long").alias("value")), by, pick, None)
    left = 1
    for r in itertools.count(1):
        if not n or hops is not None and r > hops:
            break
        if hops is None and r > PLAIN and left:
            jumps = onward(ways().filter("step = 0"), on) if r == PLAIN + 1 else ways().filter(C("step") == r - PLAIN - 1).drop("step")
            meet = [C("a.dst") == C("b.src"), *[C(f"a.{k}") == C(f"b.{k}") for k in (*on, "kind")]]
            longer = jumps.alias("a").join(jumps.alias("b"), meet).select(*[f"a.{k}" for k in on], "a.src", "b.dst", (C("a.length") + C("b.length")).alias("length"), "a.kind")
            left = written(longer.filter("src <> dst"), f"{folder}/step={r - PLAIN}")
        front = state.filter("changed").drop("changed")
        step = front.withColumnRenamed("node", "src").join(ways(), [*on, "src"]).select(*keys, C("dst").alias("node"), (C("value") + C("length")).alias("value"))
        state, n = changes(step, by, pick, state)
        if limit is not None and n and state.agg(F.max("value")).first()[0] > limit:
            raise ValueError("nodes depend on each other in a cycle")
    return state.drop("changed")


def changes(step: DataFrame, by: list[str], pick, state: DataFrame | None) -> tuple[DataFrame, int]:
    """The values of ``state`` and ``step`` by node, written, with a mark on those that are new, and how many are."""
    rows = step.withColumn("old", F.lit(None).cast("long"))
    if state is not None:
        rows = rows.unionByName(state.select(*by, "value", C("value").alias("old")))
    merged = rows.groupBy(*by).agg(pick("value").alias("value"), F.max("old").alias("old"))
    merged = merged.select(*by, "value", (C("old").isNull() | (C("old") != C("value"))).alias("changed"))
    seen, path = Observation(), new_folder(step.sparkSession)
    merged.observe(seen, F.count_if("changed").alias("n")).write.parquet(path)
    return step.sparkSession.read.schema(merged.schema).parquet(path), seen.get["n"]


def reach(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """Least hops from the start nodes to every node, along src to dst (GR-3, GR-5)."""
    return spread(edges, start.select("node", F.lit(0).alias("value")), hops=hops).select("node", C("value").cast("int").alias("hop"))


def blast_radius(edges: DataFrame, changed: DataFrame, modules: DataFrame | None = None, hops: int | None = None) -> DataFrame:
    """What depends on changed modules, and how bad that is (GR-3, SET-5, GR-11).  edges: src imports dst.

    The radius is the part of all ``modules`` (column node; the nodes of the edges, if none are given) that is affected.
    """
    found = reach(turned(edges), changed, hops)
    every = edges.select(C("src").alias("node")).union(edges.select("dst")) if modules is None else modules.select("node")
    total = every.agg(F.greatest(F.count_distinct("node"), F.lit(1)).alias("total"))
    n = lambda when: F.coalesce(F.sum(when.cast("long")), F.lit(0))
    out = found.agg(n(C("hop") == 1).alias("direct"), n(C("hop") > 1).alias("transitive"), F.count(F.lit(1)).alias("affected")).withColumn("total", total.scalar())
    radius = F.round(C("affected") / C("total").cast("double"), 4)
    risk = F.when(C("radius") > 0.3, "critical").when(C("radius") > 0.15, "high").when(C("radius") > 0.05, "medium").otherwise("low")
    return out.withColumn("radius", radius).drop("total").withColumn("risk", risk).withColumn("gate_passed", C("radius") <= 0.3)


def parents(edges: DataFrame, found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, value, parent: the least of the nodes that an edge leads from and that are one step nearer; none for starts."""
    near = found.select(*keys, C("node").alias("src"), C("value").alias("before"))
    step = near.join(edges.select("src", "dst").distinct(), "src").select(*keys, C("dst").alias("node"), (C("before") + 1).alias("value"), "src")
    return found.join(step, [*keys, "node", "value"], "left").groupBy(*keys, "node", "value").agg(F.min("src").alias("parent"))


def chains(up: DataFrame, targets: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, path: the nodes from the start to each target (keys, node; all nodes, if none are given) over a table of parents.

    Ancestors are doubled: a round gives each row of a target the row as far above it again.
    """
    up, _ = stored(up)
    ask = up if targets is None else up.join(targets.select(*keys, "node").distinct(), [*keys, "node"], "left_semi")
    rows, _ = stored(ask.select(*keys, C("node").alias("target"), "node", "value"))
    above, n = stored(up.filter("parent IS NOT NULL").select(*keys, "node", C("parent").alias("to")))
    step = 1
    while n:
        more = rows.filter(C("value") >= step).join(above, [*keys, "node"]).select(*keys, "target", C("to").alias("node"), (C("value") - step).alias("value"))
        rows, _ = stored(rows.unionByName(more))
        a, b = above.alias("a"), above.alias("b")
        on = [C(f"a.{k}") == C(f"b.{k}") for k in keys] + [C("a.to") == C("b.node")]
        above, n = stored(a.join(b, on).select(*[f"a.{k}" for k in keys], "a.node", "b.to"))
        step *= 2
    path = F.sort_array(F.collect_list(F.struct("value", "node")))
    return rows.groupBy(*keys, "target").agg(path.alias("path")).select(*keys, C("target").alias("node"), C("path.node").alias("path"))


def shortest_paths(edges: DataFrame, entries: DataFrame, hops: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """For every entry point and target (column node; all, if none are given) one shortest chain: back from the target, always over the least node (GR-6 to GR-9)."""
    keys = ("entry",)
    found, _ = stored(spread(edges, entries.select(C("node").alias("entry"), "node", F.lit(0).alias("value")), keys, hops=hops))
    ask = None if targets is None else found.join(targets.select("node").distinct(), "node", "left_semi")
    return chains(parents(edges, found, keys), ask, keys)


def nearest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """For every node that can be reached one shortest chain from the nearest start, chosen as in ``shortest_paths`` (DET-7, DET-9)."""
    found, _ = stored(spread(edges, starts.select("node", F.lit(0).alias("value"))))
    return chains(parents(edges, found))


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing leads to or that lead nowhere."""
    held = edges.join(edges.select(C("src").alias("dst")).distinct(), "dst", "left_semi")
    return held.join(edges.select(C("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def coloured(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of all strongly connected components of two nodes or more.

    Forward and backward colouring: every node takes the least colour of all nodes that lead to it, and the least of
    all that it leads to, for ``COLOURINGS`` colours of each node (hashes, anew in each pass).  Where both are the same, the
    colour's origin leads to the node and back, so they are of one component.  An edge between nodes that differ in any
    colour is in none.  What is left goes to the next pass.
    """
    left, _ = stored(edges.filter("src <> dst").select("src", "dst").distinct())
    done = None
    for r in itertools.count(1):
        left, n = stored(trimmed(trimmed(left)))
        if not n:
            break
        both = left.withColumn("side", F.lit(0)).unionByName(turned(left).withColumn("side", F.lit(1)))
        nodes = left.select(C("src").alias("node")).union(left.select("dst")).distinct()
        colours = F.array(*[F.struct(F.lit(i).alias("seed"), F.xxhash64("node", F.lit(r), F.lit(i)).alias("value")) for i in range(COLOURINGS)])
        starts = nodes.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), colours.alias("c")).select("node", "side", F.inline("c"))
        spread_to = spread(both, starts, ("side", "seed"), length=0, on=("side",))
        rows = spread_to.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("seed", "side", "value"))).alias("colours"))  # 2 * COLOURINGS in each
        own = F.expr(f"get(filter(transform(sequence(0, {COLOURINGS - 1}), i -> struct(i, colours[2 * i].value AS a, colours[2 * i + 1].value AS b)), x -> x.a = x.b), 0).a")
        rows, _ = stored(rows.select("node", "colours", own.alias("origin")))
        members = rows.filter("origin IS NOT NULL").groupBy("origin").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        found, _ = stored(rows.join(members, "origin").select("node", "component"))
        done = found if done is None else done.unionByName(found)
        open_ = rows.filter("origin IS NULL")
        of = lambda side: open_.select(C("node").alias(side), C("colours").alias(f"{side}_colours"))  # noqa: E731, B023
        left = left.join(of("src"), "src").join(of("dst"), "dst").filter("src_colours = dst_colours").select("src", "dst")
    return done if done is not None else left.select(C("src").alias("node"), C("src").alias("component"))


def block_solver():
    """A function from one block of a graph to its own components and to what may lie on cycles beyond it.

    Rows of kind 0 are edges inside the block; of kind 1 nodes (src) that other blocks lead to; of kind 2 nodes that lead to
    other blocks.  The result has rows of kind 0 for a node of a component of two or more (src) and its least node (dst), and
    of kind 1 for edges between components that lie on a way from a node of kind 1 to one of kind 2.
    """
    import numpy as np
    import pyarrow as pa

    def components(after: list[list[int]]) -> list[int]:
        """A node of its component for each node, by one depth-first walk."""
        index, low, of = [0] * len(after), [0] * len(after), [-1] * len(after)
        stack, count = [], 0
        for root in range(len(after)):
            todo = [] if index[root] else [(root, iter(after[root]))]
            while todo:
                x, rest = todo[-1]
                if not index[x]:
                    count += 1
                    index[x] = low[x] = count
                    stack.append(x)
                y = next((y for y in rest if of[y] < 0), None)
                if y is not None and not index[y]:
                    todo.append((y, iter(after[y])))
                elif y is not None:
                    low[x] = min(low[x], index[y])
                else:
                    todo.pop()
                    if todo:
                        low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                    if low[x] == index[x]:
                        while of[x] < 0:
                            of[stack.pop()] = x
        return of

    def reached(starts, after: list[list[int]]) -> set[int]:
        seen, todo = set(starts), list(starts)
        while todo:
            for y in after[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    def solve(block: pa.Table) -> pa.Table:
        kind, n = block["kind"].to_numpy(), block.num_rows
        names, code = np.unique(pa.concat_arrays([*block["src"].chunks, *block["dst"].fill_null(block["src"][0]).chunks]).to_numpy(zero_copy_only=False), return_inverse=True)
        src, dst, inside = code[:n], code[n:], kind == 0  # in order of the nodes, so the least number is the least node
        after: list[list[int]] = [[] for _ in names]
        for x, y in zip(src[inside].tolist(), dst[inside].tolist(), strict=True):
            after[x].append(y)
        _, of = np.unique(components(after), return_inverse=True)
        least = np.full(of.max() + 1, len(names))
        np.minimum.at(least, of, np.arange(len(names)))
        size, head = np.bincount(of), least[of]
        pairs = np.unique(np.stack([head[src[inside]], head[dst[inside]]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]].tolist()
        on: list[list[int]] = [[] for _ in names]
        back: list[list[int]] = [[] for _ in names]
        for x, y in pairs:
            on[x].append(y)
            back[y].append(x)
        through = reached(head[src[kind == 1]].tolist(), on) & reached(head[src[kind == 2]].tolist(), back)
        pairs = [(x, y) for x, y in pairs if x in through and y in through]
        mine = np.flatnonzero(size[of] > 1)
        left, right = np.concatenate([mine, [x for x, _ in pairs]]).astype(int), np.concatenate([head[mine], [y for _, y in pairs]]).astype(int)
        kinds = np.repeat([0, 1], [len(mine), len(pairs)]).astype(np.int32)
        return pa.table({"kind": kinds, "src": pa.array(names[left], block.schema.field("src").type), "dst": pa.array(names[right], block.schema.field("src").type)})

    return solve


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of all strongly connected components of two nodes or more.

    Edges are cut to blocks by ranges of their beginnings, ``BLOCK`` edges in each.  A block finds its own components, and keeps of
    the rest what lies on a way through it, from another block to another: often little, since names that lie together
    import each other.  Components over several blocks are found among what is kept: as one more block, if it is no larger,
    else by ``coloured``.  Nodes with more
    than ``BLOCK`` edges are in no block.
    """
    edges, n = stored(edges.filter("src <> dst").select("src", "dst").distinct())
    shape = f"kind int, src {dict(edges.dtypes)['src']}, dst {dict(edges.dtypes)['src']}"
    large = edges.groupBy("src").count().filter(C("count") > BLOCK).select("src")
    ranged, _ = stored(edges.join(large, "src", "left_anti").repartitionByRange(max(BLOCKS, -(-n // BLOCK)), "src").withColumn("block", F.spark_partition_id()))
    of = lambda side: ranged.select(C("src").alias(side), C("block").alias(f"{side}_block")).distinct()
    both, _ = stored(edges.join(edges.select(C("src").alias("dst")).distinct(), "dst", "left_semi").join(of("src"), "src", "left").join(of("dst"), "dst", "left"))
    own = both.filter("src_block = dst_block").select(C("src_block").alias("block"), F.lit(0).alias("kind"), "src", "dst")
    cross = both.filter("src_block IS NULL OR dst_block IS NULL OR src_block <> dst_block")
    edge = lambda side, kind: cross.select(C(f"{side}_block").alias("block"), F.lit(kind).alias("kind"), C(side).alias("src"), F.lit(None).alias("dst")).distinct()
    inside = own.unionByName(edge("dst", 1)).unionByName(edge("src", 2)).filter("block IS NOT NULL").select("block", "kind", "src", "dst")
    solved, _ = stored(inside.groupBy("block").applyInArrow(block_solver(), shape))
    local = solved.filter("kind = 0").select(C("src").alias("node"), C("dst").alias("head"))
    head = lambda side: local.select(C("node").alias(side), C("head").alias(f"{side}_head"))
    heads = [F.coalesce(f"{s}_head", s).alias(s) for s in ("src", "dst")]
    kept = cross.select("src", "dst").join(head("src"), "src", "left").join(head("dst"), "dst", "left").select(*heads)
    rest, m = stored(solved.filter("kind = 1").select("src", "dst").unionByName(kept).filter("src <> dst").distinct())
    if m <= BLOCK:  # what is left is no more than a block
        last = rest.select(F.lit(0).alias("block"), F.lit(0).alias("kind"), "src", "dst").groupBy("block").applyInArrow(block_solver(), shape)
        wide = last.filter("kind = 0").select(C("src").alias("head"), C("dst").alias("component"))
    else:
        wide = coloured(rest).select(C("node").alias("head"), "component")
    wide, _ = stored(wide)
    merged = local.join(wide, "head", "left").select("node", F.coalesce("component", "head").alias("component"))
    return merged.unionByName(wide.select(C("head").alias("node"), "component").join(local.select("node"), "node", "left_anti"))


def closed_walks(edges: DataFrame) -> DataFrame:
    """component, src, dst and path: one closed walk for every edge that leads back (DET-32).

    Within a strongly connected component, an edge leads back if it doesn't lead farther from the component's least node;
    every cycle holds one.  The walk goes from the edge's end to its beginning: down the shortest chain from the least node,
    where that chain holds the end, else over the least node.
    """
    of = stored(strong_components(edges))[0]
    side = lambda s: of.select(C("node").alias(s), C("component").alias(f"{s}_component"))
    inner = edges.filter("src <> dst").select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst").filter("src_component = dst_component")
    inner, _ = stored(inner.select("src", "dst", C("src_component").alias("component")))
    least = of.filter("node = component").select("node", F.lit(0).alias("value"))
    away, _ = stored(spread(inner, least))
    home, _ = stored(spread(turned(inner), least))
    far = lambda s: away.select(C("node").alias(s), C("value").alias(f"{s}_far"))
    back, _ = stored(inner.join(far("src"), "src").join(far("dst"), "dst").filter("dst_far <= src_far").select("src", "dst", "component", "dst_far"))
    down = chains(parents(inner, away), back.select(C("src").alias("node"))).select(C("node").alias("src"), C("path").alias("down"))
    # the end of an edge lies on the chain to its beginning at the place of its own distance, or not at all
    met = back.join(down, "src").withColumn("held", F.try_element_at("down", (C("dst_far") + 1).cast("int")) == C("dst"))
    met, _ = stored(met)
    over = met.filter("NOT held")
    up = chains(parents(turned(inner), home), over.select(C("dst").alias("node"))).select(C("node").alias("dst"), C("path").alias("home"))
    direct = met.filter("held").select("component", "src", "dst", F.expr("slice(down, int(dst_far) + 1, size(down))").alias("path"))
    round_about = over.join(up, "dst").select("component", "src", "dst", F.concat(F.expr("slice(reverse(home), 1, size(home) - 1)"), "down").alias("path"))
    return direct.unionByName(round_about)


def cycles(edges: DataFrame) -> DataFrame:
    """Node sets of the closed walks, one row each (DET-32)."""
    return closed_walks(edges).select(F.array_sort(F.array_distinct("path")).alias("members")).distinct()


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longest distance from a stage without dependencies: an order of stages (SRT-10).  edges: src depends on dst; a cycle is an error."""
    edges, _ = stored(edges.select("src", "dst").distinct())
    every, n = stored(nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct())
    found = spread(turned(edges), every.withColumn("value", F.lit(0)), most=True, limit=n)
    return found.select("node", C("value").cast("int").alias("level"))


def cascade(edges: DataFrame, failed: DataFrame, nodes: DataFrame, hops: int | None = None) -> DataFrame:
    """Stages that depend on a failed one are rolled back (GR-10)."""
    hit = reach(turned(edges), failed, hops)
    return nodes.join(hit, "node", "left").select("node", F.when(C("hop") == 0, "failed").when(C("hop") > 0, "rolled_back").otherwise("completed").alias("status"))


def frame(spark: SparkSession, nodes: list[int]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node int")
