"""The queries op1_ to op10_ with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from curatrix.llm import embedding_dedup, exact_topk, licenses, lm_scoring, mixing, near_dedup, packing, quality, token_counts, toxicity
from curatrix.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_classes(read(spark, sf_dir, "embeddings"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    ops: list[Query] = [
        op1_license_scans, op2_quality_classifier, op3_exact_topk_search, op4_best_fit_packing, op5_toxicity,
        op6_lm_scoring, op7_token_counts, op8_embedding_near_dedup, op9_mixing_sources, op10_minhash_near_dedup, pipeline,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": licenses.oracle_sql(), "op3_exact_topk_search": exact_topk.oracle_sql()}
