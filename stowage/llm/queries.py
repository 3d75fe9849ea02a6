"""Registered queries of the training-data operators, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import (bond, graph, lexical, lm, mixing, packing, pii, quality, rules, search, sharding, simhash,
                         toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_mix_sources", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, ''))[1:15] AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source),
p AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
q AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth FROM p),
f AS (SELECT min(nth) AS nth FROM q WHERE w * rest / heavy < cap),
t AS (
  SELECT q.source, q.source_size,
    CASE WHEN f.nth IS NULL OR q.nth < f.nth THEN q.cap
      ELSE q.w * (SELECT x.rest FROM q x, f WHERE x.nth = f.nth) / (SELECT x.heavy FROM q x, f WHERE x.nth = f.nth)
    END AS target FROM q, f),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source, source_size, target,
  (whole + CASE WHEN budget > 0 AND size > 0 AND 2 * before + size <= 2 * budget THEN 1 ELSE 0 END)::BIGINT AS copies,
  (size * (whole + CASE WHEN budget > 0 AND 2 * before + size <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""")
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


@register("op2_shard_bytes")
def op2_shard_bytes(spark, sf_dir):
    out = sharding.shard(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@register("op10_simhash_variants")
def op10_simhash_variants(spark, sf_dir):
    return simhash.simhash_classes(table(spark, sf_dir, "documents"), width=3, max_bits=3)


@register("op6_pack_hilbert")
def op6_pack_hilbert(spark, sf_dir):
    out = packing.pack(table(spark, sf_dir, "documents"), length=2048, tokenizer="byte_bpe_50k")
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset")


@register("op5_toxicity_nb")
def op5_toxicity_nb(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=5, held=0)


@register("op8_quality_neighbours")
def op8_quality_neighbours(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=4, held=2,
                                 threshold=0.7)


@register("op9_pii_weak_labels")
def op9_pii_weak_labels(spark, sf_dir):
    out = pii.find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@register("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    return rules.apply_rules(table(spark, sf_dir, "documents"))


@register("op3_top_products", r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op3_top_products(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024.0)


@register("op7_lm_context_mixing")
def op7_lm_context_mixing(spark, sf_dir):
    return lm.score_language(table(spark, sf_dir, "documents"), mod=7, held=2)


@register("op11_lexical_sketches", r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS seq, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '') AS terms FROM documents),
b AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
m AS (SELECT seq, doc_id, 25 + (75 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0),
q AS (SELECT q, item_id, term, count(*)::BIGINT AS qtf FROM (SELECT q, item_id, unnest(terms) AS term FROM b) GROUP BY ALL),
p AS (
  SELECT seq, term, count(*)::BIGINT AS tf FROM (SELECT seq, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s),
r AS (
  SELECT q.q, q.item_id, p.seq, m.doc_id,
    sum(q.qtf * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (seq) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, seq)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM n WHERE rank <= 10""")
def op11_lexical_sketches(spark, sf_dir):
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@register("op12_negatives_bond", r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same)
  WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op12_negatives_bond(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.mine_negatives(table(spark, sf_dir, "embeddings"), every=100, positives=5, negatives=10, low=30, high=90,
                               scale=256.0, label=shifted)


@register("op13_nearest_graph")
def op13_nearest_graph(spark, sf_dir):
    return graph.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)
