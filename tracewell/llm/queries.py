"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontam, langid, mixing, near_dup, pii, prefix_trie, quality, token_counts, token_store, topk, toxicity, url_filter
from ._common import held_out, read


def op1_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, apart = read(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = toxicity.fit(documents.where(~apart), read(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "sentences")


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(read(spark, sf_dir, "documents"))


def op4_raked_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, apart = read(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    trees = langid.fit(documents.where(~apart))
    return langid.predict(documents, trees).select("doc_id", apart.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op7_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", near_dup.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op10_norm_bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op11_gemm_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(read(spark, sf_dir, "embeddings"))


def op12_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_noisy_or_toxicity": op1_noisy_or_toxicity,
    "op2_cgk_decontamination": op2_cgk_decontamination,
    "op3_huffman_token_files": op3_huffman_token_files,
    "op4_raked_source_mix": op4_raked_source_mix,
    "op5_ppm_language": op5_ppm_language,
    "op6_section_token_counts": op6_section_token_counts,
    "op7_path_templates": op7_path_templates,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_norm_bucket_top_k": op10_norm_bucket_top_k,
    "op11_gemm_centroids": op11_gemm_centroids,
    "op12_robust_outliers": op12_robust_outliers,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_raked_source_mix": mixing.oracle_sql(),
    "op7_path_templates": url_filter.oracle_sql(),
    "op10_norm_bucket_top_k": """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable AS q JOIN usable AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5""",
    "op11_gemm_centroids": clustering.oracle_sql(),
    "op12_robust_outliers": quality.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(),
}
