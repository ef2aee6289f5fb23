"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="latticework-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Table:
    """A DataFrame written as Parquet and read again, cutting its lineage."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/lattice/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
