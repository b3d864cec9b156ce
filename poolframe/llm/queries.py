"""The queries of this subpackage, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolframe.llm import fingerprint, language, mixing, ngram_join, packing, quality, stages, substring_dedup, token_count, topk_search, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    field = quality.train(documents, _table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    scored = quality.score(documents, field, threshold=0.3)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(_table(spark, sf_dir, "documents"), width=5)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    fold = F.coalesce(language.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language.train(documents, ~fold & F.col("doc_id").isNotNull())
    return language.predict(documents, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "removed")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_groups(_table(spark, sf_dir, "documents"), width=5, part=75, of=100).select("doc_id", "n_shingles", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_topk_search": op6_topk_search,
    "op7_language": op7_language,
    "op8_source_mix": op8_source_mix,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ngram_join": op10_ngram_join,
    "pipeline": pipeline,
}

#: Sizes, targets by running sums, and by plain sorting the hash up to which a source is taken once more.
_OP8 = r"""
WITH d AS (SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS size,
                  substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 9) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy FROM w),
l AS (SELECT min_by((rest / heavy)::DOUBLE, struct_pack(a := cap::DOUBLE / weight, n := n)) AS level FROM r WHERE cap * heavy > weight * rest),
t AS (SELECT source, source_size, n, CASE WHEN cap * heavy <= weight * rest THEN cap::DOUBLE ELSE weight * level END AS target FROM r LEFT JOIN l ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS base FROM t),
h AS (SELECT b.n, b.target - b.base * b.source_size AS budget, d.draw, sum(d.size) AS tokens FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source GROUP BY ALL),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY n ORDER BY draw) AS upto FROM h),
e AS (SELECT n, min_by(CASE WHEN 2 * (budget - (upto - tokens)) >= tokens THEN draw || '~' ELSE draw END, draw) AS edge FROM c WHERE upto > budget GROUP BY n)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.base + CASE WHEN d.draw < coalesce(e.edge, '') THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON e.n = b.n
"""

#: Overlaps of all pairs that share a shingle, and what can be reached over the links.
_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)]) AS grams FROM w),
n AS (SELECT doc_id, len(grams)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
"""

#: Digests bit by bit into base32, and the smallest page of each payload.
_OP3 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages),
b AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hexed, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM m
"""

#: All products, ranked.
_OP6 = r"""
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.w, v.w)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op3_warc": _OP3, "op6_topk_search": _OP6, "op8_source_mix": _OP8, "op10_ngram_join": _OP10}
