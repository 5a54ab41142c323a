"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Equal lines are one form.  Two forms are linked if they are within one edit for every ``PER_EDIT``
characters of the longer one, ``EDITS`` at most.  For t edits the shorter form is cut into t + 1
segments; the longer one must hold one of them unchanged, near its place.  So forms are indexed under
their segments, together with their length, and a form probes the lengths from its own down to t
less with the few substrings that can match.  Pairs that meet are first held against a bound from
letter parities, then verified by banded bit-parallel edit distance.  Forms of fewer than
``PER_EDIT`` characters have no edit to spare: for them the rule is equality.

A line is dropped if an equal line, or one linked with it, comes earlier in (doc_id, row, line
number) order; rows are told apart by a key of their own.  Forms are told apart by 96 bits of hash.

Hot keys: a form that fills more than a thousandth of all lines (fewer than a thousand forms can) is
broadcast with its verdict and its lines are dealt evenly.  A segment that more than
``HOT_SEGMENT`` probes share is cut by hash: its probes are dealt to several tasks, each of which
sees all index rows of the segment.

Defined results: blank lines are neither compared nor dropped; white space around a line doesn't
count; null texts have no lines; null ids come first; rows that repeat an id are rows of their own,
in an order fixed by the files they lie in; an empty table gives an empty result; columns other than
id and text keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EDITS, PER_EDIT = 2, 16
HOT_SEGMENT = 4_096
#: Partitions of keys up to this size are hashed in a join, not sorted.
HASHED = "64MB"
BLANK = r"' \t\r' || chr(12) || chr(11)"  # SQL text has no escape for a form feed
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, rid, line_no (from 0), form and its two hashes, for every line that isn't blank."""
    each = docs.select("doc_id", "rid", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    each = each.select("doc_id", "rid", "line_no", F.expr(f"btrim(line, {BLANK})").alias("form")).filter("form <> ''")
    return each.select("doc_id", "rid", "line_no", "form", F.xxhash64("form").alias("h1"), F.hash("form").alias("h2"))


def forms(each: DataFrame) -> DataFrame:
    """h1, h2, form, the first place and the number of its lines."""
    return each.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rid", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("form").alias("form"))


def allowed(longer: str) -> str:
    """Edits that a pair may be apart, from the longer one's number of characters."""
    return f"least({EDITS}, cast({longer} div {PER_EDIT} AS int))"


def windows(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings that can hold an unchanged segment."""
    out = []
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            low = max(-(i - 1), less - (edits + 1 - i))
            high = min(i - 1, less + (edits + 1 - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def segments(long: DataFrame, edits: int) -> DataFrame:
    """Start and size of every segment of a form with 0 to ``edits`` characters fewer, as columns (small expressions compile well)."""
    k = edits + 1
    long = long.select("h1", "h2", "form", "n", F.expr("octet_length(form) = n").alias("plain"), *[F.expr(f"cast((n - {d}) div {k} AS int)").alias(f"size{d}") for d in range(k)], *[F.expr(f"cast((n - {d}) % {k} AS int)").alias(f"more{d}") for d in range(k)])
    starts = [F.expr(f"{1} + {i - 1} * size{d} + greatest(0, {i - 1 - k} + more{d})").alias(f"start{d}_{i}") for d in range(k) for i in range(1, k + 1)]
    sizes = [F.expr(f"size{d} + if({i} > {k} - more{d}, 1, 0)").alias(f"size{d}_{i}") for d in range(k) for i in range(1, k + 1)]
    return long.select("h1", "h2", "form", "n", "plain", *starts, *sizes)


def segment_key(edits: int, less: int, i: int, shift: int) -> str:
    """Hash of a substring of ``form`` that stands for segment i of a form with ``less`` characters fewer.

    A place outside the form gives a shorter or another text: at worst a pair that fails to verify.
    Forms of one byte a character are cut by bytes, which needs no walk to the place; the hash is that of the bytes either way.
    """
    place = f"start{less}_{i} + {shift}, size{less}_{i}"
    return f"xxhash64((n - {less}) * 64 + {edits} * 16 + {i}, if(plain, substring(cast(form AS binary), {place}), cast(substring(form, {place}) AS binary)))"


def parities() -> str:
    """One bit for each letter: whether the form holds it an odd number of times.  An edit flips two bits at most."""
    return " | ".join(f"shiftleft((length(low) - length(replace(low, '{c}', ''))) % 2, {k})" for k, c in enumerate(LETTERS))


def span(edits: int) -> tuple[str, str]:
    """Which forms probe under ``edits`` edits, by their length n, and which can be met by them."""
    upper = f" AND n < {(edits + 1) * PER_EDIT}" if edits < EDITS else ""
    return f"n >= {edits * PER_EDIT}{upper}", f"n >= {edits * PER_EDIT - edits}{upper}"


def index_rows(named: DataFrame) -> DataFrame:
    """A row for each segment of each form, for every number of edits it can be met under."""
    out = None
    for edits in range(1, EDITS + 1):
        keys = [segment_key(edits, 0, i, 0) for i in range(1, edits + 2)]
        rows = segments(named.filter(span(edits)[1]), edits).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def probe_rows(named: DataFrame) -> DataFrame:
    """A row for each substring that can hold a segment of another form, but for those that are segments of the form itself."""
    out = None
    for edits in range(1, EDITS + 1):
        keys = [segment_key(edits, d, i, s) for d, i, s in windows(edits) if (d, s) != (0, 0)]
        rows = segments(named.filter(span(edits)[0]), edits).select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def spread(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probes and index rows with keys that more than HOT_SEGMENT probes share cut into several: probes by hash, index rows copied."""
    hot = common.keep(a.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT_SEGMENT).select("key", F.ceil(F.col("m") / HOT_SEGMENT).cast("int").alias("parts")), "linehot")
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(hot, "key", "left").withColumn("cut", F.xxhash64("key", F.pmod(F.xxhash64("a1", "a2", F.lit(7)), parts).cast("int"))).drop("parts")
    b = b.join(hot, "key", "left").withColumn("cut", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("cut", F.xxhash64("key", "cut")).drop("parts")
    return a, b.withColumnRenamed("key", "b_key")


def candidates(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a1, a2), (b1, b2) of forms that share a segment and pass the parity bound; and the forms that take part.

    First only the probes and index rows that meet another form are found: by a count of the index's
    keys, and for all other probes by a semi-join with them (which lets a form meet itself, and hashes
    in place of sorting where all partitions of the keys are small); neither gives pairs.  Letter
    parities are then computed for the forms behind them alone, and the pairs are made under the
    parity bound, so a segment that many forms share gives few of them.
    """
    long = named.select("h1", "h2", "form", F.char_length("form").alias("n"))
    index = common.keep(index_rows(long), "linesegments")
    other = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    keys = common.keep(index.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "linekeys")
    moved = common.keep(probe_rows(long).join(keys.select("key"), "key", "left_semi").select("a1", "a2", "key"), "lineprobes", spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED)
    twice = keys.filter("m > 1").select("key")
    hits = common.keep(moved.select("key").union(twice).distinct(), "linehits")
    live_b = common.keep(index.join(hits, "key", "left_semi"), "lineindex")
    level = live_b.join(twice, "key", "left_semi").select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), "key")
    live_a = common.keep(level, "lineprobes").unionByName(moved)
    common.forget(index)
    part = live_a.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).unionByName(live_b.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).distinct()
    few = common.keep(named.join(part, ["h1", "h2"]).select("h1", "h2", "form", "first"), "lineforms")
    bits = few.select("h1", "h2", F.char_length("form").alias("n"), F.lower("form").alias("low")).select("h1", "h2", "n", F.expr(parities()).alias("bits"))
    bits = common.keep(bits, "linebits")
    cut_a, cut_b = spread(live_a, live_b)
    side = lambda x: bits.select(*[F.col(c).alias(f"{x}{n}") for c, n in (("h1", "1"), ("h2", "2"), ("n", "_n"), ("bits", "_bits"))])
    a = cut_a.join(side("a"), ["a1", "a2"])
    b = cut_b.join(side("b"), ["b1", "b2"])
    one_way = F.expr("a_n > b_n OR a1 > b1 OR (a1 = b1 AND a2 > b2)")
    near = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2 * EDITS
    met = a.join(b.withColumnRenamed("cut", "b_cut").hint("merge"), (F.col("cut") == F.col("b_cut")) & (F.col("key") == F.col("b_key")) & near & one_way & other)
    return met.select("a1", "a2", "b1", "b2").distinct(), few


def shared_part(side: str) -> str:
    """Length of the common prefix (or suffix) of x and y, found by halving: characters it takes away can't change the distance."""
    if side == "prefix":
        equal = "substring(x, p + 1, w) = substring(y, p + 1, w)"
    else:
        equal = "substring(x, char_length(x) - p - w + 1, w) = substring(y, char_length(y) - p - w + 1, w)"
    powers = "transform(sequence(20, 0, -1), e -> shiftleft(1, e))"
    return f"aggregate({powers}, 0, (p, w) -> p + if(p + w <= room, if({equal}, w, 0), 0))"


def bind(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once: a column would be copied into every use of it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def within(edits: int) -> str:
    """Banded bit-parallel edit distance of ``c.xs`` and ``c.ys``, at most ``edits`` or not, as an SQL expression over character arrays.

    The band has 2 * edits + 1 diagonals, one bit each.  The register for e errors has a bit set
    where the prefixes that end on this diagonal are within e edits.  A character of y moves all
    diagonals at once: a match keeps a bit; an error takes over a bit of the register with one
    error less, from the same diagonal (substitution), the next (insertion) or the last (deletion).
    """
    w, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    registers = [sum(1 << (edits + r) for r in range(e + 1)) for e in range(edits + 1)]
    start = "struct(" + ", ".join(f"{v} AS r{e}" for e, v in enumerate(registers)) + ")"
    match = " | ".join(f"if(get(c.xs, j + {i}) = c.ys[j], {1 << i}, 0)" for i in range(w))
    new = ["s.r0 & m"]
    for e in range(1, edits + 1):
        new.append(f"((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | (shiftleft({new[-1]}, 1) & {full}))")
    step = "struct(" + ", ".join(f"{x} AS r{e}" for e, x in enumerate(new)) + ")"
    moved = f"if(s.r{edits} = 0, s, {bind('m', match, step)})"
    apart = f"size(c.xs) - {2 * edits} - size(c.ys)"
    return f"if(size(c.ys) = 0, true, aggregate(sequence(0, size(c.ys) - 1), {start}, (s, j) -> {moved}, s -> (shiftright(s.r{edits}, {apart} + {edits}) & 1) = 1))"


def verified(pairs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of ``pairs`` whose columns x and y are within ``edits`` edits."""
    middle = lambda t: f"filter(split(substring({t}, pre + 1, char_length({t}) - pre - suf), ''), l -> l <> '')"
    pad = f"array_repeat('', {edits})"
    test = bind("c", f"struct(concat({pad}, {middle('x')}, {pad}) AS xs, {middle('y')} AS ys)", within(edits))
    test = bind("suf", bind("room", "least(char_length(x), char_length(y)) - pre", shared_part("suffix")), test)
    test = bind("pre", bind("room", "least(char_length(x), char_length(y))", shared_part("prefix")), test)
    return pairs.filter(F.expr(f"abs(char_length(x) - char_length(y)) <= {edits} AND {test}"))


def linked(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose columns x and y are within the edits that their length allows."""
    mine = pairs.withColumn("may", F.expr(allowed("greatest(char_length(x), char_length(y))")))
    out = None
    for edits in range(1, EDITS + 1):
        some = verified(mine.filter(F.col("may") == edits), edits)
        out = some if out is None else out.unionByName(some)
    return out.drop("may")


def verdicts(rows: DataFrame) -> DataFrame:
    """For each form its first place, copies, number of forms linked to it and their earliest place; rows: doc_id, rid, text."""
    named = common.keep(forms(lines(rows)), "linenames")
    pairs, few = candidates(named)
    side = lambda s, t: few.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("form").alias(t), F.col("first").alias(f"first_{t}"))
    both = common.keep(pairs.join(side("a", "x"), ["a1", "a2"]).join(side("b", "y"), ["b1", "b2"]), "linepairs")
    links = common.keep(linked(both).select("a1", "a2", "b1", "b2", "first_x", "first_y"), "linelinks")
    ways = links.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("first_y").alias("near")).unionByName(links.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("first_x").alias("near")))
    near = ways.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_links"), F.min("near").alias("near"))
    return named.drop("form").join(near, ["h1", "h2"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def classes(rows: DataFrame) -> DataFrame:
    """Every line of doc_id, rid, text with its verdict and whether it stays."""
    found = common.keep(verdicts(rows).select("h1", "h2", "copies", F.struct("first", "near", "n_links").alias("v")), "lineverdicts")
    out = common.split_join(lines(rows).drop("form"), found, ["h1", "h2"], ["doc_id", "rid", "line_no"])
    here, first, near = F.struct("doc_id", "rid", "line_no"), F.col("v.first"), F.col("v.near")
    return out.select("doc_id", "rid", "line_no", first.alias("first"), near.alias("near"), F.col("v.n_links").alias("n_links"), ((here == first) & (near.isNull() | (first < near))).alias("kept"))


def line_classes(docs: DataFrame) -> DataFrame:
    """Every line with its class (first place of an equal line), the earliest line near it, its links and whether it stays."""
    out = classes(common.row_ids(docs).select("doc_id", "rid", "text"))
    return out.select(
        "doc_id",
        "line_no",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        F.col("near.doc_id").alias("near_doc_id"),
        F.col("near.line_no").alias("near_line_no"),
        "n_links",
        "kept",
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the dropped lines; documents that lose every line go."""
    rows = common.row_ids(docs)
    dropped = classes(rows.select("doc_id", "rid", "text")).filter(~F.col("kept"))
    dropped = common.keep(dropped.groupBy("rid").agg(F.collect_set("line_no").alias("gone")), "lines")
    joined = rows.join(dropped, "rid", "left")
    stay = "array_except(sequence(0, size(split(text, '\\n')) - 1), gone)"
    text = F.expr(f"if(gone IS NULL OR text IS NULL, text, transform(array(split(text, '\\n')), ls -> array_join(transform({stay}, i -> ls[i]), '\\n'))[0])")
    rest = joined.withColumn("text", text).filter(F.col("gone").isNull() | F.expr(f"btrim(text, {BLANK} || '\\n') <> ''"))
    chars = F.when(F.col("gone").isNull(), F.col("row.`n_chars`")).otherwise(F.char_length("text").cast("long")) if "n_chars" in docs.columns else None
    return common.restored(rest, docs, n_chars=chars)
