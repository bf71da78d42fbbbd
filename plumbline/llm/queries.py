"""The operators of this package as named queries, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import align, bilinear, language, mixing, packing, rans, search, sharding, simhash, toxicity, variants, vectors, warc
from plumbline.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    docs = sharding.with_shards(docs, "doc_id", 16)
    docs = sharding.with_shards(docs, "doc_id", 17, "grown_shard")
    return sharding.with_slots(docs, "shard")


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=4, distance=4)


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_rans(spark: SparkSession, folder: str) -> DataFrame:
    return rans.round_trip(table(spark, folder, "documents"))


@query
def op5_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    # as few sequences as tokens allow: a sequence of one-token pieces holds 2048 of them
    return packing.pack(table(spark, folder, "documents"), most_pieces=packing.SIZE)


@query
def op6_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    return language.held_out_predictions(table(spark, folder, "documents"))


@query
def op7_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(table(spark, folder, "pages"), smallest=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    targets = {"1": 0.9, "0": 0.1}
    return mixing.rates(table(spark, folder, "documents"), table(spark, folder, "labels"), targets, by_row=True)


@query
def op10_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"), threshold=0.95)


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(spread(table(spark, folder, "documents").select("doc_id", "text")), slip_every=199)


@query
def op12_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return bilinear.held_out_scores(docs, language.fold("doc_id", 5) == 1)


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = align.alignments(spread(table(spark, folder, "documents").select("doc_id", "text")))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return align.with_pair_counts(found.withColumn("groups_sha256", digest).drop("groups"))


SQL["op1_jump_shards"] = """
WITH RECURSIVE
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, size, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UBIGINT)),
      lambda a, b: xor(crc_table.t[(xor(a, b) & 255)::BIGINT + 1], a >> 8)))::BIGINT AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM d, crc_table),
keys AS (SELECT DISTINCT k FROM c),
jump AS (
  SELECT k, n, k::HUGEINT AS state, -1::BIGINT AS b, 0::BIGINT AS j FROM keys, (VALUES (16), (17)) s(n)
  UNION ALL
  SELECT k, n, (state * 2862933555777941757 + 1) % 18446744073709551616, j,
    trunc((j + 1)::DOUBLE * (2147483648.0::DOUBLE
      / (((state * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT
  FROM jump WHERE j < n),
landed AS (SELECT k, n, b FROM jump WHERE j >= n),
placed AS (
  SELECT doc_id, size, text_crc32, 'key' AS law, a.b::INTEGER AS shard, g.b::INTEGER AS grown_shard
  FROM c JOIN landed a ON a.k = c.k AND a.n = 16 JOIN landed g ON g.k = c.k AND g.n = 17)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', coalesce(doc_id::VARCHAR, chr(0)),
    size::VARCHAR, text_crc32::VARCHAR, law, shard::VARCHAR, grown_shard::VARCHAR)), doc_id) - 1 AS slot
FROM placed
"""

SQL["op7_ball_tree"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

SQL["op10_multi_index"] = """
WITH RECURSIVE
v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

SQL["op8_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, h, from_hex(h)::BIT::VARCHAR AS bits,
    min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    lpad(substr(bits, (5 * i + 1)::BIGINT, 5), 8, '0')::BIT::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c, hex(encode(concat(id, ':', run))) AS h FROM runs GROUP BY id, run),
hashed AS (
  SELECT run, c, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UBIGINT)),
      lambda a, b: xor(crc_table.t[(xor(a, b) & 255)::BIGINT + 1], a >> 8)))::BIGINT AS h
  FROM counted, crc_table),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
  FROM hashed),
w AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
holes AS (
  SELECT word, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
links AS (
  SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION
  SELECT h.word, w.word FROM holes h JOIN w ON w.word = h.l || h.r
  UNION
  SELECT w.word, h.word FROM holes h JOIN w ON w.word = h.l || h.r),
near AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS top FROM links JOIN w ON w.word = b GROUP BY a),
best AS (
  SELECT near.word, n_near, top, min(b) AS form
  FROM near JOIN links ON links.a = near.word JOIN w ON w.word = b AND w.n = top GROUP BY ALL),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN top >= 5 * w.n THEN form END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
