"""Stencils, surfaces, halos and joins between boxes and points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import points as P
from latticework.functions.points import Vec
from latticework.model import AXES, ChunkSpec, Extent
from latticework.operators.maps import axes, chunk_min, in_extent, keys, keys_of_boxes


def surface_points(solid: DataFrame, extent: Extent) -> DataFrame:
    """Solid points of a 2D or 3D extent with a neighbour, along an axis, that isn't solid. solid: distinct
    occupied points, also around the extent. One explode and one equality join; no window needs order."""
    names = AXES[: extent.dim]
    near = [f"n{a}" for a in names]
    inside = solid.select(*names).where(in_extent(extent))
    around = P.neighbours(inside, P.VON_NEUMANN_3 if extent.dim == 3 else P.VON_NEUMANN_2, names, near)
    there = solid.select(*[F.col(a).alias(n) for a, n in zip(names, near)])
    return around.join(there, near, "left_anti").select(*names).distinct()


def visible_faces(voxels: DataFrame, opaque: Column | str = "opaque") -> DataFrame:
    """(x, y, z, axis, sign) of faces that need a mesh. voxels: non-empty points with a flag opaque. An
    opaque neighbour hides a face, and a transparent one hides that of a transparent voxel."""
    own = voxels.select(*AXES, F.col(opaque).alias("o") if isinstance(opaque, str) else opaque.alias("o"))
    sides = F.array(*[F.struct(F.lit("xyz"[a]).alias("axis"), F.lit(s).alias("sign"), *[F.lit(s if a == b else 0).cast("long").alias(f"d{n}") for b, n in enumerate(AXES)]) for a in range(3) for s in (-1, 1)])
    faces = own.withColumn("f", F.explode(sides)).select(*AXES, "o", "f.axis", "f.sign", *[(F.col(n) + F.col(f"f.d{n}")).alias(f"n{n}") for n in AXES])
    other = own.select(*[F.col(n).alias(f"n{n}") for n in AXES], F.col("o").alias("no"))
    return faces.join(other, ["nx", "ny", "nz"], "left").where("no is null or (o and not no)").select(*AXES, "axis", "sign")


def neighbour_sum(points: DataFrame, offsets, value: str = "v", ambient: float = 0.0) -> DataFrame:
    """Sum over a neighbourhood of 2D or 3D offsets, vacant neighbours counting as ambient: each value is sent to
    the points it counts for, and summed there."""
    names = AXES[: len(offsets[0])]
    near = [f"n{a}" for a in names]
    back = [tuple(-d for d in o) for o in offsets]
    sent = P.neighbours(points.select(*names, value), back, names, near).groupBy(*near).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    sent = sent.select(*[F.col(n).alias(a) for a, n in zip(names, near)], "s", "k")
    joined = points.join(sent, list(names), "left")
    return joined.select(*points.columns, (F.coalesce("s", F.lit(0)) + (len(offsets) - F.coalesce("k", F.lit(0))) * F.lit(ambient)).alias("around"))


def halo(points: DataFrame, spec: ChunkSpec, pad: int = 1, upper: int | None = None) -> DataFrame:
    """points, each in every chunk whose extent padded by `pad` has it, as columns of the chunk's key.
    Interior points go to one chunk; the halo alone is copied."""
    upper = pad if upper is None else upper
    out = points
    for a, k, s in zip(axes(spec), keys(spec), spec.shape):
        own = F.col(a).bitwiseAND(F.lit(~(s - 1)).cast("long"))
        below, above = F.when(F.col(a) - own < upper, own - s), F.when(F.col(a) - own >= s - pad, own + s)
        out = out.withColumn(k, F.explode(F.array_compact(F.array(own, below, above))))
    return out


def chunk_neighbours(chunks: DataFrame, spec: ChunkSpec) -> DataFrame:
    """(key, neighbour's key) for present Moore neighbours of each chunk."""
    own = chunks.select(*keys(spec))
    names = [f"n{a}" for a in axes(spec)]
    moves = [tuple(d * s for d, s in zip(o, spec.shape)) for o in (P.MOORE_3 if spec.dim == 3 else P.MOORE_2)]
    near = P.neighbours(own, moves, keys(spec), names)
    return near.join(own.select(*[F.col(k).alias(n) for k, n in zip(keys(spec), names)]), names, "left_semi")


def points_in_boxes(points: DataFrame, boxes: DataFrame, spec: ChunkSpec) -> DataFrame:
    """points x boxes that have them; boxes are [x0, x1) x .. and are matched by chunk key first."""
    keyed = points.withColumns(dict(zip(keys(spec), chunk_min(Vec.of(*axes(spec)), spec).parts)))
    wide = keys_of_boxes(boxes, spec)
    inside = reduce(lambda a, b: a & b, ((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in axes(spec)))
    return keyed.join(wide, list(keys(spec))).where(inside).drop(*keys(spec))


def count_in_boxes(points: DataFrame, boxes: DataFrame, spec: ChunkSpec, key: str = "id") -> DataFrame:
    """(key, n) of boxes with points in them. Equal points are counted before they meet a box."""
    counted = points.groupBy(*axes(spec)).agg(F.count("*").alias("__n"))
    return points_in_boxes(counted, boxes, spec).groupBy(key).agg(F.sum("__n").alias("n"))


def boxes_in_chunks(boxes: DataFrame, chunks: DataFrame, spec: ChunkSpec) -> DataFrame:
    """Boxes x present chunks that overlap them."""
    return keys_of_boxes(boxes, spec).join(chunks, list(keys(spec)))


def spheres_on_chunks(spheres: DataFrame, chunks: DataFrame, spec: ChunkSpec) -> DataFrame:
    """spheres (x, y, z, r) x chunks whose bounding spheres they touch (strictly): cells of chunk size
    around each sphere's box, then the distance."""
    reach = chunk_radius(spec)
    low = [F.floor(F.col(a) - F.col("r") - reach).cast("long") for a in axes(spec)]
    high = [F.ceil(F.col(a) + F.col("r") + reach).cast("long") + 1 for a in axes(spec)]
    boxed = spheres.withColumns({**{f"{a}0": v for a, v in zip(axes(spec), low)}, **{f"{a}1": v for a, v in zip(axes(spec), high)}})
    centre = Vec(*[F.col(k) + s / 2 for k, s in zip(keys(spec), spec.shape)])
    joined = keys_of_boxes(boxed, spec).join(chunks, list(keys(spec)))
    near = (Vec.of(*axes(spec)) - centre).norm() < F.col("r") + reach
    return joined.where(near).drop(*[f"{a}{i}" for a in axes(spec) for i in (0, 1)])


def chunk_radius(spec: ChunkSpec) -> float:
    """Bounding radius of a chunk; the root of 3 in 2D, too."""
    return (max(spec.shape) >> 1) * 3.0**0.5
