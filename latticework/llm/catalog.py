"""Queries opN_<name> over the whole of their tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import bpe, embeddings, exact, langid, mixing, pages, passages, secrets, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(table(spark, sf_dir, "labels"), docs))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", mixing.token_count(kept["text"]).alias("n_tokens"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_groups(table(spark, sf_dir, "embeddings"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_secret_scan, op3_toxicity, op4_simhash_near_dedup, op5_language_id, op6_html_extraction, op7_exact_dedup, op8_source_mixing, op9_embedding_near_dedup, op10_byte_level_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact.SQL.format(docs="documents"), "op8_source_mixing": mixing.SQL.format(docs="documents"), "op9_embedding_near_dedup": embeddings.SQL}
