"""Reading and writing of sparse lattice maps.

A map is a table of chunks (lod, cx, cy, cz, an array a channel) under a ChunkSpec; what has no chunk
has the ambient value. A write gives a new table. Boxes become chunk keys, so that every join is an
equality on keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.points import Vec, from_stride, stride
from latticework.model import AXES, KEYS, ChunkSpec, Extent
from latticework.sources.scan import scan


def axes(spec) -> tuple[str, ...]:
    return AXES[: spec.dim]


def keys(spec) -> tuple[str, ...]:
    return KEYS[: spec.dim]


def in_extent(extent: Extent, names=None) -> Column:
    """min <= p < lub in every component; plain comparisons, so that scans can skip row groups."""
    p = Vec.of(*(names or AXES[: extent.dim]))
    return Vec(*extent.minimum).less_equal(p) & p.less(Vec(*extent.lub))


def chunk_min(p: Vec, spec: ChunkSpec) -> Vec:
    """Minimum of the chunk that has the point; right for negative coordinates."""
    return Vec(*(c.bitwiseAND(F.lit(~(s - 1)).cast("long")) for c, s in zip(p.parts, spec.shape)))


def local_index(p: Vec, spec: ChunkSpec) -> Column:
    return stride(Vec(*(c.bitwiseAND(F.lit(s - 1).cast("long")) for c, s in zip(p.parts, spec.shape))), spec.shape)


def with_keys(points: DataFrame, spec: ChunkSpec) -> DataFrame:
    p = Vec.of(*axes(spec))
    return points.withColumns({**dict(zip(keys(spec), chunk_min(p, spec).parts)), "idx": local_index(p, spec)})


def chunk_keys(spark, spec: ChunkSpec, extent: Extent) -> DataFrame:
    """A row for every chunk that overlaps the extent."""
    if extent.is_empty():
        return scan(spark, Extent((0,) * spec.dim, (0,) * spec.dim)).toDF(*keys(spec))
    low = tuple(c // s for c, s in zip(extent.minimum, spec.shape))
    high = tuple(c // s for c, s in zip(extent.maximum, spec.shape))
    slots = scan(spark, Extent.from_corners(low, high))
    return slots.select(*[(F.col(a) * s).alias(k) for a, k, s in zip(AXES, keys(spec), spec.shape)])


def keys_of_boxes(boxes: DataFrame, spec: ChunkSpec, low=("x0", "y0", "z0"), high=("x1", "y1", "z1")) -> DataFrame:
    """boxes with a row for every chunk that each overlaps; [low, high) a row. Empty boxes have none."""
    out = boxes
    for a, (k, s) in enumerate(zip(keys(spec), spec.shape)):
        shift = s.bit_length() - 1
        first, last = F.shiftright(F.col(low[a]), shift), F.shiftright(F.col(high[a]) - 1, shift)
        out = out.where(F.col(high[a]) > F.col(low[a])).withColumn(k, F.explode(F.sequence(first, last))).withColumn(k, F.col(k) * s)
    return out


def to_points(chunks: DataFrame, spec: ChunkSpec, extent: Extent | None = None) -> DataFrame:
    """Points of present chunks, each channel at its point; chunks outside the extent are skipped whole."""
    if extent is not None:
        reach = Extent.from_lub(tuple(m - s + 1 for m, s in zip(extent.minimum, spec.shape)), extent.lub)
        chunks = chunks.where(in_extent(reach, keys(spec)))
    channels = list(spec.channels)
    rest = [c for c in chunks.columns if c not in channels and c not in keys(spec)]
    flat = chunks.select(*rest, *keys(spec), F.posexplode(F.arrays_zip(*channels)).alias("idx", "__v"))
    p = from_stride(F.col("idx").cast("long"), spec.shape) + Vec.of(*keys(spec))
    out = flat.select(*rest, *p.named(*axes(spec)), *[F.col(f"__v.{c}").alias(c) for c in channels])
    return out if extent is None else out.where(in_extent(extent))


def to_chunks(points: DataFrame, spec: ChunkSpec, lod: int = 0) -> DataFrame:
    """Chunks of points with distinct coordinates; the rest of a chunk is ambient."""
    tagged = with_keys(points, spec)
    packed = tagged.groupBy(*keys(spec)).agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct(*spec.channels).alias("c")))).alias("m"))
    return packed.select(F.lit(lod).alias("lod"), *keys(spec), *[_densify(F.col("m"), c, v, spec).alias(c) for c, v in spec.channels.items()])


def _densify(m: Column, channel: str, ambient, spec: ChunkSpec) -> Column:
    every = F.sequence(F.lit(0).cast("long"), F.lit(spec.volume - 1).cast("long"))
    return F.transform(every, lambda i: F.coalesce(F.try_element_at(m, i)[channel], F.lit(ambient)))


def ambient_array(value, spec: ChunkSpec) -> Column:
    return F.array_repeat(F.lit(value), spec.volume)


def visit_chunks(chunks: DataFrame, spec: ChunkSpec, extent: Extent, lod: int = 0) -> DataFrame:
    """All chunks that overlap the extent, ambient ones standing in for those that are absent."""
    wanted = chunk_keys(chunks.sparkSession, spec, extent)
    own = chunks.where(F.col("lod") == lod).select(*keys(spec), *spec.channels)
    joined = wanted.join(own, list(keys(spec)), "left")
    first = next(iter(spec.channels))
    return joined.select(
        F.lit(lod).alias("lod"), *keys(spec), *[F.coalesce(F.col(c), ambient_array(v, spec)).alias(c) for c, v in spec.channels.items()], F.col(first).isNull().alias("is_ambient")
    )


def read_extent(chunks: DataFrame, spec: ChunkSpec, extent: Extent, lod: int = 0) -> DataFrame:
    """Every point of the extent, ambient where the map has none."""
    return to_points(visit_chunks(chunks, spec, extent, lod).drop("is_ambient", "lod"), spec, extent)


def get_points(points: DataFrame, chunks: DataFrame, spec: ChunkSpec, lod: int = 0) -> DataFrame:
    """points with each channel's value there."""
    own = chunks.where(F.col("lod") == lod).select(*keys(spec), *[F.col(c).alias(f"__{c}") for c in spec.channels])
    joined = with_keys(points, spec).join(own, list(keys(spec)), "left")
    return joined.select(*points.columns, *[F.coalesce(F.get(f"__{c}", F.col("idx").cast("int")), F.lit(v)).alias(c) for c, v in spec.channels.items()])


def set_points(chunks: DataFrame, writes: DataFrame, spec: ChunkSpec, lod: int = 0) -> DataFrame:
    """The map with the points written; a write into vacant space makes an ambient chunk around it.
    writes has a row a point at most."""
    packed = with_keys(writes, spec).groupBy(*keys(spec)).agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct(*spec.channels).alias("c")))).alias("m"))
    rest = chunks.where(F.col("lod") != lod).select("lod", *keys(spec), *spec.channels)
    own = chunks.where(F.col("lod") == lod).select(*keys(spec), *spec.channels).join(packed, list(keys(spec)), "full_outer")
    every = F.sequence(F.lit(0), F.lit(spec.volume - 1))

    def merged(c, ambient):
        old = F.coalesce(F.col(c), ambient_array(ambient, spec))
        new = F.transform(every, lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("long"))[c], F.get(old, i)))
        return F.when(F.col("m").isNull(), old).otherwise(new).alias(c)

    return rest.unionByName(own.select(F.lit(lod).alias("lod"), *keys(spec), *[merged(c, v) for c, v in spec.channels.items()]))


def overlay(below: DataFrame, above: DataFrame, on) -> DataFrame:
    """Rows of above, and those of below whose key it doesn't have."""
    return below.join(above.select(*on), list(on), "left_anti").unionByName(above.select(*below.columns))


def write_extent(chunks: DataFrame, source: DataFrame, spec: ChunkSpec, extent: Extent, lod: int = 0) -> DataFrame:
    """The map with the source's points inside the extent copied in."""
    return set_points(chunks, source.where(in_extent(extent)).select(*axes(spec), *spec.channels), spec, lod)


def map_extent(chunks: DataFrame, spec: ChunkSpec, extent: Extent, lod: int = 0, **new: Callable[[Vec], Column] | Column) -> DataFrame:
    """The map with channels inside the extent replaced by expressions over x, y, z (as a Vec) or by
    constants: array work inside each chunk, absent ones made ambient first. Only chunks that overlap
    the extent are touched."""
    touched = visit_chunks(chunks, spec, extent, lod).drop("is_ambient")
    rest = chunks.select("lod", *keys(spec), *spec.channels).join(chunk_keys(chunks.sparkSession, spec, extent).withColumn("lod", F.lit(lod)), ["lod", *keys(spec)], "left_anti")
    base = Vec.of(*keys(spec))

    def changed(c):
        def at(v, i):
            p = from_stride(i.cast("long"), spec.shape) + base
            inside = Vec(*extent.minimum).less_equal(p) & p.less(Vec(*extent.lub))
            value = new[c](p) if callable(new[c]) and not isinstance(new[c], Column) else new[c]
            return F.when(inside, value).otherwise(v)

        return F.transform(F.col(c), at).alias(c)

    return rest.unionByName(touched.select("lod", *keys(spec), *[changed(c) if c in new else c for c in spec.channels]))


def fill_extent(chunks: DataFrame, spec: ChunkSpec, extent: Extent, lod: int = 0, **values) -> DataFrame:
    return map_extent(chunks, spec, extent, lod, **{c: F.lit(v) for c, v in values.items()})


def reset_values(chunks: DataFrame, spec: ChunkSpec, **values) -> DataFrame:
    return chunks.withColumns({c: ambient_array(v, spec) for c, v in values.items()})


def copy_extent(source: DataFrame, source_spec: ChunkSpec, target: DataFrame, target_spec: ChunkSpec, extent: Extent) -> DataFrame:
    """INSERT ... SELECT between maps, of whatever chunk shapes: the ambient of the source is copied, too."""
    return write_extent(target, read_extent(source, source_spec, extent), target_spec, extent)


def transform(chunks: DataFrame, spec: ChunkSpec, **f: Callable[[Column], Column]) -> tuple[DataFrame, ChunkSpec]:
    """A map of changed values and its spec: the ambient value goes through the same function."""
    spark = chunks.sparkSession
    changed = chunks.withColumns({c: F.transform(c, g) for c, g in f.items()})
    ambient = spark.range(1).select(*[(f[c](F.lit(v)) if c in f else F.lit(v)).alias(c) for c, v in spec.channels.items()]).first().asDict()
    return changed, ChunkSpec(spec.shape, ambient, spec.root_lod)


def palette(points: DataFrame, table: DataFrame, key: str, at: str, default=None) -> DataFrame:
    """points with the palette's columns for the id in `key`; ids it doesn't have get the default."""
    rest = [c for c in table.columns if c != at]
    joined = points.join(table.withColumnRenamed(at, "__k"), F.col(key) == F.col("__k"), "left").drop("__k")
    return joined if default is None else joined.withColumns({c: F.coalesce(c, F.lit(default)) for c in rest})


def translate(points: DataFrame, by) -> DataFrame:
    return points.withColumns({a: F.col(a) + d for a, d in zip(AXES, by)})


def strided(points: DataFrame, origin, step) -> DataFrame:
    """Every step-th sample from the origin, in sample coordinates."""
    p = Vec.of(*AXES[: len(step)]) - Vec(*origin)
    kept = points.where((p % Vec(*step)).equals(Vec(*[0] * len(step))) & Vec(*[0] * len(step)).less_equal(p))
    return kept.withColumns(dict(zip(AXES, p.div(Vec(*step)).parts)))


def lock_step(left: DataFrame, right: DataFrame, shift, value: str = "v", step=(1, 1, 1)) -> DataFrame:
    """Positional join of two maps: right's point p * step + shift stands beside left's p."""
    moved = Vec.of(*AXES[: len(shift)]) * Vec(*step[: len(shift)]) + Vec(*shift)
    keyed = left.withColumns({f"__{a}": c for a, c in zip(AXES, moved.parts)})
    other = right.select(*[F.col(a).alias(f"__{a}") for a in AXES[: len(shift)]], F.col(value).alias("other"))
    return keyed.join(other, [f"__{a}" for a in AXES[: len(shift)]]).drop(*[f"__{a}" for a in AXES])


def zip_maps(spec: ChunkSpec, *maps_: DataFrame) -> DataFrame:
    """Points of any number of chunk maps of one spec side by side, as v0, v1, ...: where one has a chunk that another
    lacks, the other's points are ambient. One join on chunk keys a map; arrays are zipped inside the chunk."""
    channel, ambient = next(iter(spec.channels.items()))
    out = None
    for i, chunks in enumerate(maps_):
        own = chunks.select(*keys(spec), F.col(channel).alias(f"v{i}"))
        out = own if out is None else out.join(own, list(keys(spec)), "full_outer")
    filled = out.select(*keys(spec), *[F.coalesce(f"v{i}", ambient_array(ambient, spec)).alias(f"v{i}") for i in range(len(maps_))])
    return to_points(filled, ChunkSpec(spec.shape, {f"v{i}": ambient for i in range(len(maps_))}, spec.root_lod))


def bounding_extent(points: DataFrame, names=AXES) -> DataFrame:
    """One row: least and exclusive greatest coordinates; raises on no points."""
    found = points.agg(*[F.min(n).alias(f"{n}0") for n in names], *[(F.max(n) + 1).alias(f"{n}1") for n in names])
    return found.withColumn(f"{names[0]}0", F.when(F.col(f"{names[0]}0").isNull(), F.raise_error(F.lit("no points to bound"))).otherwise(F.col(f"{names[0]}0")))


def bounding_chunks(chunks: DataFrame, spec: ChunkSpec, lod: int = 0) -> DataFrame:
    """Bounding box of the occupied chunks of a level, an exact aggregate."""
    own = chunks.where(F.col("lod") == lod)
    return own.agg(*[F.min(k).alias(f"{a}0") for k, a in zip(keys(spec), AXES)], *[(F.max(k) + s).alias(f"{a}1") for k, a, s in zip(keys(spec), AXES, spec.shape)])
