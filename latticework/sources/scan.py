"""Lattices made on the fly: functions of the point, constants, flat buffers, images and fixtures."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import fields
from latticework.functions.points import Vec, from_stride
from latticework.model import AXES, Extent


def scan(spark: SparkSession, extent: Extent) -> DataFrame:
    """A row a point, from a distributed range of row-major offsets: nothing is crossed or collected."""
    p = from_stride(F.col("id"), extent.shape) + Vec(*[F.lit(m).cast("long") for m in extent.minimum])
    return spark.range(max(0, extent.volume) if min(extent.shape) > 0 else 0).select(*p.named(*AXES[: extent.dim]))


def func(spark: SparkSession, extent: Extent, **channels: Callable[[Vec], Column] | Column) -> DataFrame:
    """Points of the extent with each channel as a function of the point."""
    points = scan(spark, extent)
    p = Vec.of(*AXES[: extent.dim])
    return points.withColumns({n: f(p) if callable(f) and not isinstance(f, Column) else f for n, f in channels.items()})


def fill(spark: SparkSession, extent: Extent, **values) -> DataFrame:
    return func(spark, extent, **{n: F.lit(v) for n, v in values.items()})


def from_arrays(df: DataFrame, extent: Extent, values: str = "values", value: str = "v") -> DataFrame:
    """Points of rows that hold an extent's values as one flat array; other sizes raise."""
    checked = F.when(F.size(values) == extent.volume, F.col(values)).otherwise(F.raise_error(F.lit("the buffer's length isn't the extent's volume")))
    rest = [c for c in df.columns if c != values]
    flat = df.select(*rest, F.posexplode(checked).alias("__i", value))
    p = from_stride(F.col("__i").cast("long"), extent.shape) + Vec(*[F.lit(m).cast("long") for m in extent.minimum])
    return flat.select(*rest, *p.named(*AXES[: extent.dim]), value)


def noise(spark: SparkSession, extent: Extent, frequency: float, seed: int, octaves: int = 1) -> DataFrame:
    return func(spark, extent, v=lambda p: fields.noise(p, frequency, seed, octaves))


def solid_sphere(spark: SparkSession, edge: int, inner=1, outer=0) -> DataFrame:
    """A cube of this edge about the origin with a ball of radius edge / 2 - 1, its surface excluded."""
    box = Extent.cube((-(edge // 2),) * 3, edge)
    return func(spark, box, v=lambda p: F.when(p.norm() < edge / 2 - 1, F.lit(inner)).otherwise(F.lit(outer)))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Binary PGM and PPM files as (path, x, y, channels), the minimum at the origin."""

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                fields_, at = [], 0
                while len(fields_) < 4:
                    while r.content[at : at + 1].isspace():
                        at += 1
                    if r.content[at : at + 1] == b"#":
                        at = r.content.index(b"\n", at)
                        continue
                    end = at
                    while not r.content[end : end + 1].isspace():
                        end += 1
                    fields_.append(r.content[at:end])
                    at = end
                w, h, n = int(fields_[1]), int(fields_[2]), 3 if fields_[0] == b"P6" else 1
                body = r.content[at + 1 :]
                yield pd.DataFrame({"path": r.path, "x": [i % w for i in range(w * h)], "y": [i // w for i in range(w * h)], "channels": [list(body[i * n : i * n + n]) for i in range(w * h)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, x long, y long, channels array<int>")


def encode_image(points: DataFrame, extent: Extent, value: str = "channels") -> DataFrame:
    """(width, height, image): a PPM of an array<int> channel, or a PGM of a number, over a 2D extent."""
    if min(extent.shape) <= 0:
        raise ValueError("an image needs a positive shape")
    many = points.schema[value].dataType.typeName() == "array"
    w, h = extent.shape
    inside = Vec.of("x", "y")
    own = points.where(Vec(*extent.minimum).less_equal(inside) & inside.less(Vec(*extent.lub)))
    rows = own.groupBy().agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("c")))).alias("px"))

    def encode(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                body = bytearray(w * h * (3 if many else 1))
                for px in r.px:
                    at = (px["y"] - extent.minimum[1]) * w + px["x"] - extent.minimum[0]
                    if many:
                        body[3 * at : 3 * at + 3] = bytes(int(c) & 255 for c in px["c"][:3])
                    else:
                        body[at] = int(px["c"]) & 255
                yield pd.DataFrame({"width": [w], "height": [h], "image": [f"P{6 if many else 5}\n{w} {h}\n255\n".encode() + bytes(body)]})

    return rows.mapInPandas(encode, "width int, height int, image binary")


def vox_chunks(data: bytes):
    """(id, content) of the chunks inside MAIN of a .vox file."""
    if data[:4] != b"VOX ":
        raise ValueError("not a .vox file")
    at = 20
    while at + 12 <= len(data):
        kind, size, _ = data[at : at + 4], *struct.unpack("<ii", data[at + 4 : at + 12])
        yield kind, data[at + 12 : at + 12 + size]
        at += 12 + size


def read_vox(spark: SparkSession, path: str, model: int | None = None) -> DataFrame:
    """(model, x, y, z, color_index, rgba) of .vox files, occupied voxels only. An index that isn't
    there gives no rows."""

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                found, palette, i = [], None, 0
                for kind, body in vox_chunks(r.content):
                    if kind == b"XYZI":
                        for k in range(struct.unpack("<i", body[:4])[0]):
                            x, y, z, c = body[4 + 4 * k : 8 + 4 * k]
                            found.append((i, x, y, z, c))
                        i += 1
                    elif kind == b"RGBA":
                        palette = struct.unpack("<256I", body[:1024])
                out = pd.DataFrame(found, columns=["model", "x", "y", "z", "color_index"])
                out["rgba"] = [palette[c - 1] if palette else None for c in out["color_index"]]
                yield out

    files = spark.read.format("binaryFile").load(path).select("content")
    voxels = files.mapInPandas(decode, "model int, x long, y long, z long, color_index int, rgba long")
    return voxels if model is None else voxels.where(F.col("model") == model)


def encode_vox(points: DataFrame, extent: Extent, color: str = "color_index") -> DataFrame:
    """(vox): one model of the extent, at most 255 an axis, moved to the origin; null colours are empty."""
    if max(extent.shape) > 255:
        raise ValueError("a .vox model has at most 255 voxels an axis")
    p = Vec.of("x", "y", "z")
    own = points.where(F.col(color).isNotNull() & Vec(*extent.minimum).less_equal(p) & p.less(Vec(*extent.lub)))
    rows = own.groupBy().agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", F.col(color).alias("c")))).alias("v"))

    def encode(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                body = struct.pack("<i", len(r.v)) + b"".join(bytes(int(v[a]) - m for a, m in zip("xyz", extent.minimum)) + bytes([int(v["c"])]) for v in r.v)
                size = struct.pack("<iii", *extent.shape)
                inner = b"SIZE" + struct.pack("<ii", 12, 0) + size + b"XYZI" + struct.pack("<ii", len(body), 0) + body
                yield pd.DataFrame({"vox": [b"VOX " + struct.pack("<i", 150) + b"MAIN" + struct.pack("<ii", 0, len(inner)) + inner]})

    return rows.mapInPandas(encode, "vox binary")
