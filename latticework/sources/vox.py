"""spark.read.format("vox"): models of .vox files, a partition a file.

    spark.dataSource.register(VoxDataSource)
    spark.read.format("vox").option("modelIndex", 0).load(path)
"""

from __future__ import annotations

import glob
import os
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from latticework.sources.scan import vox_chunks


class VoxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vox"

    def schema(self) -> str:
        return "model int, x long, y long, z long, color_index int, rgba long"

    def reader(self, schema) -> "VoxReader":
        return VoxReader(self.options)


class VoxReader(DataSourceReader):
    """Files of a path or pattern that driver and executors share. modelIndex: one model; an index that a
    file doesn't have gives no rows."""

    def __init__(self, options: dict):
        path = options["path"].removeprefix("file://")
        self.files = sorted(glob.glob(os.path.join(path, "*.vox")) if os.path.isdir(path) else glob.glob(path))
        self.model = options.get("modelIndex")

    def partitions(self) -> list:
        return [InputPartition(f) for f in self.files] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        with open(partition.value, "rb") as f:
            chunks = list(vox_chunks(f.read()))
        palette = next((struct.unpack("<256I", body[:1024]) for kind, body in chunks if kind == b"RGBA"), None)
        models = (body for kind, body in chunks if kind == b"XYZI")
        for i, body in enumerate(models):
            if self.model is None or i == int(self.model):
                for k in range(struct.unpack("<i", body[:4])[0]):
                    x, y, z, c = body[4 + 4 * k : 8 + 4 * k]
                    yield (i, x, y, z, c, palette[c - 1] if palette else None)
