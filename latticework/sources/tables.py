"""The driver tables as lattices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.model import ChunkSpec

#: embeddings: an 8 x 8 x 8 grid of 4^3 chunks, vacant where there is no vector
SDF = ChunkSpec((4, 4, 4), {"v": 1.0}, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sdf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("lod"), (4 * (i % 8)).alias("cx"), (4 * (F.shiftright(i, 3) % 8)).alias("cy"), (4 * F.shiftright(i, 6)).alias("cz"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label")
    )


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"), F.col("l_quantity").cast("long").alias("z"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 32).alias("x"), F.dayofmonth("ts").cast("long").alias("y"), "value")
    return e.groupBy("x", "y").agg(F.round(F.avg("value"), 6).alias("h"))
