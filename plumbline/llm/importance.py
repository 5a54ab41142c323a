"""Target-distribution importance resampling over hashed word n-grams.

DuckDB counts inside each partition: its SQL cuts texts to words, unnests them, forms the runs of one
to three words by window functions and counts buckets of a zlib CRC.  The counts of every document are
spilled to Parquet; Spark merges them over all documents, scores each document by its buckets'
gains and draws the highest scores with Gumbel noise that a document's id decides.

Texts are counted a few megabytes at a time.  A longer text is cut between words; each part repeats
the two words before it, which only complete the runs that end in the part, and the parts' counts are
added up, so memory doesn't grow with a text.

Defined results: a null text has no words; a row is a document, so rows that repeat an id count as
often as they are there, and score by the same noise; a null id has the noise of the text ``null``;
a document without words weighs 0; ties of scores go to the smaller id, then to fewer features; with no
eligible document or an empty table nothing is drawn; an empty target gives every bucket the gain
of its own counts alone; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from . import common

BUCKETS = 10_000
#: Characters of texts that one SQL statement counts.
PART = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
COUNTED = "rid long, doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"

#: ``carry`` words at the beginning belong to the part before.
COUNT = f"""
WITH texts AS MATERIALIZED (SELECT place, carry, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM part),
each AS (SELECT place, carry, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts),
runs AS (
  SELECT place, i > carry AS own, w AS one, lag(w) OVER before || ' ' || w AS two, lag(w, 2) OVER before || ' ' || lag(w) OVER before || ' ' || w AS three
  FROM each WINDOW before AS (PARTITION BY place ORDER BY i)),
features AS (
  SELECT place, list(one) || coalesce(list(two) FILTER (two IS NOT NULL), []) || coalesce(list(three) FILTER (three IS NOT NULL), []) AS f FROM runs WHERE own GROUP BY place),
hashed AS (SELECT place, (unnest(crc32s(f)) % {BUCKETS})::INT AS bucket FROM features),
buckets AS (SELECT place, bucket, count(*)::INT AS n FROM hashed GROUP BY ALL),
lists AS (SELECT place, list(bucket) AS buckets, list(n) AS counts, sum(n)::BIGINT AS n_features FROM buckets GROUP BY place)
SELECT place, (len(words) - carry)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM texts LEFT JOIN lists USING (place) ORDER BY place
"""


def crc32s(lists: pa.Array) -> pa.Array:
    """zlib's CRC of every text of every list."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    texts = lists.flatten()
    found = np.fromiter(map(zlib.crc32, texts.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint32, len(texts))
    ends = np.cumsum(pc.coalesce(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found))


class Counter:
    """A DuckDB connection of one task, which counts the buckets of texts."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.con.create_function("crc32s", crc32s, ["VARCHAR[]"], "UINTEGER[]", type="arrow")

    def count(self, texts: list[str], carry: int = 0) -> pa.Table:
        part = pa.table({"place": pa.array(range(len(texts)), pa.int64()), "carry": pa.array([carry] * len(texts), pa.int32()), "text": pa.array(texts, pa.string())})
        self.con.register("part", part)
        try:
            return self.con.sql(COUNT).to_arrow_table()
        finally:
            self.con.unregister("part")

    def long(self, text: str) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Words, features, buckets and counts of one long text, a part at a time."""
        sums, n_words, at, before = np.zeros(BUCKETS, np.int64), 0, 0, []
        while at < len(text):
            gap = GAP.search(text, min(at + PART, len(text)))
            end = gap.end() if gap else len(text)
            got = self.count([" ".join([*before, text[at:end]])], len(before))
            n_words += got["n_words"][0].as_py()
            np.add.at(sums, got["buckets"].combine_chunks().flatten().to_numpy(), got["counts"].combine_chunks().flatten().to_numpy())
            before, at = self.last_two(before, text, at, end), end
        used = np.flatnonzero(sums)
        return n_words, int(sums.sum()), used, sums[used]

    @staticmethod
    def last_two(before: list[str], text: str, at: int, end: int) -> list[str]:
        found, stop = [], end
        while len(found) < 2 and stop > at:
            while stop > at and GAP.match(text, stop - 1):
                stop -= 1
            start = stop
            while start > at and not GAP.match(text, start - 1):
                start -= 1
            if start < stop:
                found.insert(0, text[start:stop])
            stop = start
        return [*before, *found][-2:]


def counted(batches):
    """Arrow batches of rid, doc_id and text -> one row of ``COUNTED`` each."""
    counter = Counter()
    for batch in batches:
        at = 0
        sizes = pc.coalesce(pc.binary_length(batch["text"]), 0).to_numpy()
        while at < batch.num_rows:
            end, room = at + 1, PART - sizes[at]
            while end < batch.num_rows and room >= sizes[end]:
                room -= sizes[end]
                end += 1
            some = batch.slice(at, end - at)
            texts = [t or "" for t in some["text"].to_pylist()]
            if end == at + 1 and len(texts[0]) > PART:
                words, features, buckets, n = counter.long(texts[0])
                columns = [[words], [features], [buckets.tolist()], [n.tolist()]]
            else:
                got = counter.count(texts)
                columns = [got[c].combine_chunks() for c in ("n_words", "n_features", "buckets", "counts")]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([some["rid"], some["doc_id"], *columns], names=["rid", "doc_id", "n_words", "n_features", "buckets", "counts"])
            at = end


def bucket_counts(texts: DataFrame, name: str) -> DataFrame:
    """The spilled counts of every row of rid, doc_id and text."""
    return common.keep(texts.select("rid", "doc_id", "text").mapInArrow(counted, COUNTED), name)


def merged(counts: DataFrame) -> DataFrame:
    """Occurrences of each bucket over all rows."""
    each = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e")).select("e.buckets", F.col("e.counts").cast("long").alias("n"))
    return each.groupBy(F.col("buckets").alias("bucket")).agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> Column:
    """The gain of every bucket, in thousandths, as one constant array: ``BUCKETS`` numbers whatever the tables hold."""
    every = source.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sizes = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    d = lambda c: F.col(c).cast("double") + 1.0
    ratio = d("t") * F.lit(float(sizes.s + BUCKETS)) / (d("s") * F.lit(float(sizes.t + BUCKETS)))
    rows = dict(both.select("bucket", F.floor(1000.0 * F.log(ratio))).collect())
    return F.split(F.lit(",".join(str(rows[b]) for b in range(BUCKETS))), ",").cast("array<long>")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and, for the ``share`` percent drawn, rank of every document; ``target`` has a column text."""
    common.prepare(docs.sparkSession)
    source = bucket_counts(common.row_ids(common.columns(docs, "doc_id", "text")), "buckets")
    wanted = bucket_counts(target.select(F.lit(0).cast("long").alias("rid"), F.lit(0).cast("long").alias("doc_id"), F.col("`text`").alias("text")), "target")
    gain = gains(common.keep(merged(source), "source-sums"), common.keep(merged(wanted), "target-sums"))
    weight = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: n.cast("long") * F.get(gain, b)), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = source.select("rid", "doc_id", "n_features", (F.col("n_words") >= least_words).alias("eligible"), weight.alias("weight"))
    scored = common.keep(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    drawn = scored.filter("eligible").count() * share // 100
    placed = numbered(scored, [F.desc("eligible"), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("rid")])
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("position") <= drawn, F.col("position")).alias("rank"))
