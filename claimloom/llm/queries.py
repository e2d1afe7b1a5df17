"""The operators of this subpackage as queries on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import (
    balance,
    hard_negatives,
    language,
    lattice_dedup,
    licenses,
    minmax_dedup,
    packing,
    resampling,
    routed_search,
    suffix_dedup,
    template,
    token_blocks,
    toxicity,
)
from claimloom.llm.common import held, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = suffix_dedup.remove_repeats(docs, length=400, keep_first=False, whole_characters=False)
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")  # a character cut in two shows as U+FFFD
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text)


def op2_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held("doc_id", 4, 2)))
    found = language.identify(docs, model)
    held_out = F.coalesce(held("doc_id", 4, 2), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op5_routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = balance.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held("doc_id", 5, 0)))
    held_out = F.coalesce(held("doc_id", 5, 0), F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = resampling.resample(docs, target, longest=1, buckets=10_000, seed=2024, least_words=20, percent=10)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.round_trip(table(spark, sf_dir, "documents"), end=2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_lattice_dedup,
        op3_packing,
        op4_language,
        op5_routed_search,
        op6_minmax_dedup,
        op7_mixing,
        op8_toxicity,
        op9_page_text,
        op10_licenses,
        op11_resampling,
        op12_hard_negatives,
        op13_token_blocks,
    )
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op2_lattice_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT k.a AS vec_id, coalesce(n.n_links, 0) AS n_links, k.component_id, k.a = k.component_id AS kept
FROM (SELECT a, min(b) AS component_id FROM r GROUP BY a) k LEFT JOIN n ON n.vec_id = k.a
""",
    "op6_minmax_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) k ON k.a = d.doc_id
""",
    "op11_resampling": r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
f AS (SELECT n, unnest(w) AS w FROM d),
v AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION SELECT w FROM b)), crc),
s AS (SELECT k, count(*) AS s FROM f JOIN v USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN v USING (w) GROUP BY k),
g AS (
  SELECT q.k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS g
  FROM (SELECT DISTINCT k FROM v) q LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
e AS (SELECT n, sum(g)::BIGINT AS weight FROM f JOIN v USING (w) JOIN g USING (k) GROUP BY n),
z AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN e USING (n)),
a AS (SELECT count(*) AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * a.n // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM z), a
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, c.n AS c, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score
  FROM v a JOIN v c ON a.n <> c.n WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, anchor_id, c, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, c) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.a, p.c ORDER BY score DESC, id, s.c)
QUALIFY row_number() OVER w <= 5
""",
}
