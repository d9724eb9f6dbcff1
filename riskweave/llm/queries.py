"""The registered query of each corpus operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    centroids, decontamination, line_dedup, mixing, near_dedup, ngram_join, passage_dedup, repetition, secret_scan, sharding, spelling,
    token_counts, token_files,
)
from riskweave.llm.common import documents

LLM_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_REGISTRY[function.__name__] = function
    return function


@query
def op1_aligned_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["start"], b["until"])), ",")
    return left.select(
        "doc_id", "n_lines", "n_deleted", F.coalesce(spans, F.lit("")).alias("blocks"), "first_from", F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query
def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir)).drop("spans", "longest_repeat")


@query
def op4_sparse_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(documents(spark, sf_dir)).drop("text_order", "earlier_id")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


@query
def op6_latent_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.leaks(documents(spark, sf_dir), benchmark).drop("text_order")


@query
def op7_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("text_order", "root")


@query
def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@query
def op9_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_rows(documents(spark, sf_dir))


@query
def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir)).drop("n_random")


@query
def op11_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("centroid_sha256", centroids.digest(F.col("centroid"))).drop("centroid")


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


@query
def op13_ngram_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir)).drop("root")
