"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. Nulls, empty and very long texts, ties,
repeated rows, empty tables and extra columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import bpe, exact, mixing, simhash, toxicity
from latticework.llm.common import Table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels, documents = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("labels", "documents"))
    return toxicity.drop_toxic(docs, labels, documents)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_exact_copies),
    ("SimHash near-dedup", remove_near_copies),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: Toxicity, SimHash and BPE have no SQL form; the tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, written = written, Table(docs)
            docs = written.df
            if before is not None:
                before.drop()
    return docs
