"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard, licenses, packing, suffix_dedup, tokens, topk, toxicity, url_filter
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("glob_hit")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_passages(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, and runs of 512 characters, which cut tokens: those go where most of their characters are."""
    return tokens.section_token_counts(table(spark, sf_dir, "documents"), rule="most", kinds=(("line", None), ("run", 512)))


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_jaccard_join, op4_url_filter, op5_exact_topk, op6_toxicity, op7_license_scan, op8_best_fit_packing, op9_bpe_transducer, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.oracle_sql()
