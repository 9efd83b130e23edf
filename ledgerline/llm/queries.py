"""The thin queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import clusters, id_shards, lm_scores, mixing, nearest, negatives, oracles, packing, pieces, quality, repeats, shingle_join, telephony, token_counts
from ledgerline.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.stored_text_media(table(spark, sf_dir, "documents"), telephony.mean_resample)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op7_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_shards.stored_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_join(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores.lm_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", *(F.round(c, 4).alias(c) for c in ("log_score", "mean_log_score")))


OP9_SQL = """
WITH w AS (
  SELECT doc_id, rowid_ AS doc, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, row_number() OVER () AS rowid_,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
        FROM documents)
), g AS (
  SELECT doc_id, doc, i, w AS c, lag(w) OVER d AS b, lag(w, 2) OVER d AS a FROM w WINDOW d AS (PARTITION BY doc ORDER BY i)
), k AS (
  SELECT doc_id, doc, i,
    count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, doc) AS c1,
    CASE WHEN i >= 1 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY b, c, doc) ELSE 0 END AS c2,
    CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY a, b, c, doc) ELSE 0 END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc) AS n
  FROM g
), p AS (
  SELECT *, lag(c1) OVER d AS p1, lag(c2) OVER d AS p2 FROM k WINDOW d AS (PARTITION BY doc ORDER BY i)
), s AS (
  SELECT doc_id, doc, ln(CASE WHEN i >= 2 AND c3 > 0 THEN c3 / p2::DOUBLE
    WHEN i >= 1 AND c2 > 0 THEN c2 / p1::DOUBLE * CASE WHEN i >= 2 THEN 0.4 ELSE 1 END
    ELSE greatest(c1, 0.5) / greatest(n, 1)::DOUBLE * pow(0.4, least(i, 2)) END) AS v
  FROM p
)
SELECT d.doc_id, count(v) AS n_words, round(coalesce(sum(v), 0), 4) AS log_score, round(avg(v), 4) AS mean_log_score
FROM (SELECT doc_id, row_number() OVER () AS doc FROM documents) d LEFT JOIN s USING (doc) GROUP BY d.doc, d.doc_id
"""


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest, op2_token_counts, op3_quality, op4_media, op5_repeats, op6_packing, op7_id_shards, op8_shingle_join, op9_lm_scores, op10_pieces, op11_mixing, op12_hard_negatives, op13_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op9_lm_scores": OP9_SQL, "op11_mixing": oracles.OP11_SQL, "op12_hard_negatives": oracles.OP12_SQL, "op13_clusters": oracles.OP13_SQL}
