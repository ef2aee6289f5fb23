"""Levels of detail: samplers, mip chains, and keys across levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.points import Vec
from latticework.model import ChunkSpec
from latticework.operators.maps import axes, keys, overlay, to_chunks, to_points
from latticework.operators.plumbing import Table


def parent_key(p: Vec, spec: ChunkSpec, levels: int = 1) -> Vec:
    return Vec(*(F.shiftright(c.bitwiseAND(F.lit(~((s << levels) - 1)).cast("long")), levels) for c, s in zip(p.parts, spec.shape)))


def child_key(p: Vec, corner: Column, spec: ChunkSpec) -> Vec:
    return Vec(*(F.shiftleft(c, 1) + F.shiftright(corner, a).bitwiseAND(F.lit(1)) * s for a, (c, s) in enumerate(zip(p.parts, spec.shape))))


def corner_of(p: Vec, spec: ChunkSpec) -> Column:
    """Which child of its parent a chunk is, as 0bZYX."""
    out = F.lit(0).cast("long")
    for a, (c, s) in enumerate(zip(p.parts, spec.shape)):
        out = out + F.shiftleft(F.shiftright(c, s.bit_length() - 1).bitwiseAND(F.lit(1).cast("long")), a)
    return out


def destination(chunks: DataFrame, spec: ChunkSpec) -> DataFrame:
    """chunks with the parent's key and where in it each one's samples go."""
    p = Vec.of(*keys(spec))
    up, corner = parent_key(p, spec), corner_of(p, spec)
    offset = [F.shiftright(corner, a).bitwiseAND(F.lit(1).cast("long")) * (s // 2) for a, s in enumerate(spec.shape)]
    return chunks.withColumns({**{f"parent_{k}": v for k, v in zip(keys(spec), up.parts)}, **{f"at_{a}": v for a, v in zip(axes(spec), offset)}})


def extent_at_lower_lod(chunks: DataFrame, spec: ChunkSpec, lod: int) -> DataFrame:
    """chunks with the box [x0, x1) .. that each covers at a finer level."""
    up = F.col("lod") - lod
    scale = F.pow(F.lit(2), up).cast("long")
    return chunks.withColumns({**{f"{a}0": F.col(k) * scale for a, k in zip(axes(spec), keys(spec))}, **{f"{a}1": (F.col(k) + s) * scale for a, k, s in zip(axes(spec), keys(spec), spec.shape)}})


def sample_points(points: DataFrame, dim: int = 3) -> DataFrame:
    """Samples with even coordinates, halved."""
    names = "xyz"[:dim]
    even = F.lit(True)
    for n in names:
        even = even & (F.col(n).bitwiseAND(F.lit(1).cast("long")) == 0)
    return points.where(even).withColumns({n: F.shiftright(n, 1) for n in names})


def sample_mean(points: DataFrame, channels, dim: int = 3, bits: int | None = None) -> DataFrame:
    """Mean of each block of 2^dim signed distances, halved as distances halve with the scale. Points
    must be dense in each block; bits: of quantised distances, whose mean is cut towards zero."""
    names = list("xyz"[:dim])
    half = [F.shiftright(n, 1).alias(n) for n in names]
    mean = {c: F.sum(F.col(c).cast("double")) / float(2 << dim) for c in channels}
    if bits:
        mean = {c: v.cast("tinyint" if bits == 8 else "smallint") for c, v in mean.items()}
    return points.groupBy(*half).agg(*[v.alias(c) for c, v in mean.items()])


def sampled(points: DataFrame, spec: ChunkSpec, sampler, bits: int | None = None) -> DataFrame:
    """Points of the next level: sampler is "mean", "point", or a function of an array of the 2^dim values of a block
    (by 0bZYX) that gives a Column, applied to each channel."""
    if sampler == "point":
        return sample_points(points, spec.dim)
    if sampler == "mean":
        return sample_mean(points, list(spec.channels), spec.dim, bits)
    names = axes(spec)
    corner = sum((F.shiftleft(F.col(a).bitwiseAND(F.lit(1).cast("long")), i) for i, a in enumerate(names)), F.lit(0).cast("long"))
    packed = points.withColumn("__c", corner).groupBy(*[F.shiftright(a, 1).alias(a) for a in names]).agg(*[F.sort_array(F.collect_list(F.struct("__c", F.col(c).alias("v")))).alias(c) for c in spec.channels])
    return packed.select(*names, *[sampler(F.transform(c, lambda s: s["v"])).alias(c) for c in spec.channels])


def downsample(chunks: DataFrame, spec: ChunkSpec, lod: int, sampler="mean", bits: int | None = None) -> DataFrame:
    """The next coarser level of one level: a chunk a parent with a child. Vacant children leave their
    part ambient, unscaled; stored ones are sampled."""
    points = to_points(chunks.where(F.col("lod") == lod).select(*keys(spec), *spec.channels), spec)
    return to_chunks(sampled(points, spec, sampler, bits), spec, lod + 1)


def downsample_under(chunks: DataFrame, spec: ChunkSpec, lod: int, key, sampler="mean", target: DataFrame | None = None, lod0: DataFrame | None = None) -> DataFrame:
    """The chunk of level lod at key, made from its descendants of level 0 in `chunks` (or in lod0, a table of
    another kind projected to these channels), with all levels between; laid over `target`, or alone.
    Other chunks of `target` stay as they are."""
    source = (chunks if lod0 is None else lod0).where("lod = 0").select("lod", *keys(spec), *spec.channels)
    above = parent_key(Vec.of(*keys(spec)), spec, lod) if lod else Vec.of(*keys(spec))
    made = mip_chain(source.where(above.equals(Vec(*key))), spec, lod, sampler).where("lod > 0")
    if target is None:
        return made
    return overlay(target.select("lod", *keys(spec), *spec.channels), made, ["lod", *keys(spec)])


def mip_chain(chunks: DataFrame, spec: ChunkSpec, top: int, sampler="mean", bits: int | None = None, lod0: DataFrame | None = None) -> DataFrame:
    """chunks of level 0 (of lod0, if given: a table of another kind projected to these channels) and all coarser
    levels to `top`: a shuffle a level, each 1 / 2^dim of the last and written once."""
    if top > spec.root_lod:
        raise ValueError("no level above the root")
    level = (chunks if lod0 is None else lod0).where("lod = 0").select("lod", *keys(spec), *spec.channels)
    out = level
    for lod in range(top):
        level = Table(downsample(level, spec, lod, sampler, bits)).df
        out = out.unionByName(level)
    return out
