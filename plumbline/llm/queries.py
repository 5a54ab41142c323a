"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, idstore, importance, langid, linedup, lm, neardup, negatives, packing, pieces, quality, sharding, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards, sizes near equal, by a stored map; and their shards in its next version, with 17."""
    out = sharding.assign(table(spark, sf_dir, "documents"), shards=16, map_folder=common.scratch_path(spark, "slotmap"), grown=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version", "next_shard", "next_version")


@query
def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and host-aware verdict of every document."""
    out = quality.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUALITY_CTES = r"""
texts AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
windows AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM words WHERE len(w) > 3),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts),
per_lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (
  SELECT t.rid, t.doc_id, t.source, len(w)::BIGINT AS n_words, (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM texts t JOIN words USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN per_lines USING (rid)),
flags AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
judged AS (
  SELECT *, base_failed OR 20 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 15 * n_words AS failed FROM flags),
per_host AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM judged GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(1 / n) AS q FROM per_host),
weighed AS (SELECT m, greatest(least(m * (1 - m) / greatest(v - m * (1 - m) * q, 1e-6) - 1, 1000), 2) AS k FROM prior),
hosts AS (SELECT source AS host, (f + m * k) / (n + k) > 0.6 AS host_rejected FROM per_host, weighed)
"""

ORACLE["op5_host_quality"] = f"""
WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT host_rejected AS kept
FROM judged JOIN hosts ON source IS NOT DISTINCT FROM host
"""


@query
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, by integer inner product."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE["op7_exact_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.e, max(list_inner_product(q.e, c.e))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@query
def op4_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), length=4096, end=2)


@query
def op9_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ids in ascending order of doc_id and read back from the files."""
    docs = table(spark, sf_dir, "documents")
    manifest = idstore.write(docs, common.scratch_path(spark, "idstore"), idstore.shard_count(docs), end=1)
    return idstore.read(spark, manifest)


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 leaves another remainder than 2."""
    docs = table(spark, sf_dir, "documents")
    learn = langid.trainable(4, 2)
    out = langid.predict(docs, langid.train(docs, learn))
    return out.select("row.doc_id", "lang_pred", "score").withColumn("held_out", ~learn)


@query
def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    return pieces.round_trip(table(spark, sf_dir, "documents"))


@query
def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; learned from those whose crc32 modulo 7 isn't 2."""
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a similarity of 0.75 or more on 5-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op8_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""


@query
def op1_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents: class of equal lines, links within 2 edits, and whether the line stays."""
    return linedup.line_classes(table(spark, sf_dir, "documents"))


ORACLE["op1_line_edit_join"] = """
WITH each AS (
  SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS form FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM documents)),
named AS (SELECT form, min({'d': doc_id, 'l': line_no}) AS first, length(form) AS n FROM each WHERE form <> '' GROUP BY form),
pairs AS (
  SELECT a.form AS x, b.form AS y, a.first AS fx, b.first AS fy FROM named a JOIN named b ON b.n BETWEEN a.n AND a.n + 2 AND a.form <> b.form AND (a.n < b.n OR a.form < b.form)
  WHERE levenshtein(a.form, b.form) <= least(2, b.n // 16)),
ways AS (SELECT x AS form, fy AS near FROM pairs UNION ALL SELECT y, fx FROM pairs),
links AS (SELECT form, count(*) AS n_links, min(near) AS near FROM ways GROUP BY form)
SELECT doc_id, line_no, first.d AS class_doc_id, first.l AS class_line_no, near.d AS near_doc_id, near.l AS near_line_no, coalesce(n_links, 0) AS n_links,
       doc_id = first.d AND line_no = first.l AND (near IS NULL OR first < near) AS kept
FROM each JOIN named USING (form) LEFT JOIN links USING (form)
"""


@query
def op13_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, as one example for each reply; read back from the examples."""
    turns = common.columns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digest(common.keep(chat.examples(turns.unionByName(planted)), "chat", spark__sql__parquet__compression__codec="zstd"))


ORACLE["op13_prefix_targets"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS planted(a, b, c, d)),
p AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|/TURN\]|/?s>)', '\1\\\2\3', 'g') AS safe,
         regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|/TURN\]|/?s>)', '\1\\\2\3', 'g') AS name FROM t),
m AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST]' || safe || '[/INST]' WHEN 'assistant' THEN '<s>' || safe || '</s>' WHEN 'system' THEN '[SYS]' || safe || '[/SYS]'
    ELSE '[ROLE]' || name || '[/ROLE]' || safe || '[/TURN]' END AS piece FROM p),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, piece) AS i, count(*) OVER (PARTITION BY conv_id) AS n, count(*) OVER (PARTITION BY conv_id) > 64 AS long FROM m),
b AS (SELECT *, CASE WHEN long THEN turn // 64 ELSE 0 END AS block FROM o),
s AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, block ORDER BY i) AS upto, i = max(i) OVER (PARTITION BY conv_id, block) AS last FROM b)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR last)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


@query
def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document against the benchmark's n-grams, and the rank of the 5 in 100 drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_bounded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE["op11_bounded_lists"] = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
one AS (SELECT vec_id, label, e FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM one a JOIN one c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5
"""
