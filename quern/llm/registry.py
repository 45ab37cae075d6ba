"""Queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fertility, line_dedup, mixing, near_dedup, packing, secrets, sharding, toxicity, url_rules, vector_join


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "rules", "blocked")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.counted(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    found = (op1_minhash, op2_url_rules, op3_packing, op4_toxicity, op5_sharding, op6_mixing, op7_secrets, op8_fertility, op9_line_dedup, op10_embeddings)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": url_rules.sql(), "op6_mixing": mixing.SQL, "op9_line_dedup": line_dedup.SQL, "op10_embeddings": vector_join.SQL}
