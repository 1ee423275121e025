"""One query per operator, with production parameters, over whole tables.

``QUERIES`` maps names to (spark, sf_dir) -> DataFrame; ``ORACLES`` holds DuckDB SQL
where SQL can express the result at the size of the tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe_dp, jaccard_join, kn_quality, langid, line_dedup, lm_scoring, mixing, mtree, rans, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return lm_scoring.score(spark, table(spark, sf_dir, "documents"), good)


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(spark, table(spark, sf_dir, "documents"))


def op3_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_dp.encode_decode(spark, docs, public_tokenizers.path("word_bpe_49k.json"), finish=bpe_dp.as_digests, outputs=bpe_dp.DIGESTS)


def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op5_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(spark, table(spark, sf_dir, "embeddings"))


def op6_shingle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(spark, table(spark, sf_dir, "documents"))


def op7_rans_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_and_read(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.judge(spark, table(spark, sf_dir, "documents"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", "removed_bytes", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op10_mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = mixing.mix(spark, docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.col(mixing.TOKENS).alias("n_tokens"), F.col(mixing.POST).alias("posterior"), "rate", F.col(mixing.RESIDUAL).alias("residual"))


QUERIES = {
    "op1_cross_entropy": op1_cross_entropy,
    "op2_gear_chunks": op2_gear_chunks,
    "op3_bpe_prefix_dp": op3_bpe_prefix_dp,
    "op4_ppm_language": op4_ppm_language,
    "op5_mtree_topk": op5_mtree_topk,
    "op6_shingle_links": op6_shingle_links,
    "op7_rans_shards": op7_rans_shards,
    "op8_kn_quality": op8_kn_quality,
    "op9_line_chunks": op9_line_chunks,
    "op10_mixture_rates": op10_mixture_rates,
}
ORACLES: dict[str, str] = {}
