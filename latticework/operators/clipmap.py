"""Levels of detail around observers: slots to load, active sets, and the changes between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.points import Vec
from latticework.model import ChunkSpec
from latticework.operators.maps import axes, keys
from latticework.operators.plumbing import Table
from latticework.operators.pyramid import child_key, parent_key

LOADING, RENDER = 0, 1


def bounding_sphere(spec: ChunkSpec, lod: Column) -> tuple[Vec, Column]:
    """(centre, radius) of a chunk in voxels of level 0; the root of 3 in 2D, too."""
    scale = F.pow(F.lit(2), lod)
    centre = Vec(*[F.col(k) * scale + F.floor(F.lit(s) * scale / 2) for k, s in zip(keys(spec), spec.shape)])
    return centre, F.floor(F.lit(max(spec.shape)) * scale / 2) * F.lit(3.0**0.5)


def sphere_slots(spheres: DataFrame, spec: ChunkSpec, lod: int, detail: float = 6.0) -> DataFrame:
    """spheres (id, x, y, z, r) x chunk slots of a level whose bounding spheres they touch, present or not:
    (id, key, dist, is_candidate). Slots are made from each sphere's box."""
    scale = 2**lod
    half = (max(spec.shape) * scale) // 2 * 3.0**0.5
    out = spheres
    for a, k, s in zip(axes(spec), keys(spec), spec.shape):
        low = F.floor((F.col(a) - F.col("r") - half) / (s * scale)).cast("long")
        high = F.floor((F.col(a) + F.col("r") + half) / (s * scale)).cast("long")
        out = out.withColumn(k, F.explode(F.sequence(low, high))).withColumn(k, F.col(k) * s)
    centre, radius = bounding_sphere(spec, F.lit(lod))
    dist = (centre - Vec.of(*axes(spec))).norm()
    out = out.withColumn("dist", dist).where(F.col("dist") < F.col("r") + radius)
    return out.withColumn("is_candidate", F.lit(lod == 0) | (F.col("dist") / radius > detail)).select("id", *keys(spec), "dist", "is_candidate")


def new_slots(old: DataFrame, new: DataFrame, spec: ChunkSpec, lod: int, detail: float = 6.0) -> DataFrame:
    """Slots that a sphere touches after its move and didn't before."""
    before = sphere_slots(old, spec, lod, detail).select("id", *keys(spec))
    return sphere_slots(new, spec, lod, detail).join(before, ["id", *keys(spec)], "left_anti")


def nearest_ancestors(chunks: DataFrame, spec: ChunkSpec) -> tuple[Table, Table]:
    """(chunks without a present ancestor; edges from each other chunk to its nearest present one), by joins on
    keys, a level apart at a time."""
    left = chunks.select("lod", *keys(spec)).distinct()
    there = left.select(F.col("lod").alias("plod"), *[F.col(k).alias(f"p{k}") for k in keys(spec)])
    edges = []
    for up in range(1, spec.root_lod + 1):
        above = parent_key(Vec.of(*keys(spec)), spec, up)
        keyed = left.withColumns({**{f"p{k}": v for k, v in zip(keys(spec), above.parts)}, "plod": F.col("lod") + up})
        on = ["plod", *[f"p{k}" for k in keys(spec)]]
        edges.append(keyed.join(there, on, "left_semi").select("lod", *keys(spec), *on))
        left = keyed.join(there, on, "left_anti").select("lod", *keys(spec))
    empty = left.where("false").select("*", F.lit(0).alias("plod"), *[F.col(k).alias(f"p{k}") for k in keys(spec)])
    return Table(left), Table(reduce(DataFrame.unionByName, edges, empty))


def active(chunks: DataFrame, observers: DataFrame, spec: ChunkSpec, detail: float) -> DataFrame:
    """(id, lod, key) of chunks to render for each observer (id, x, y, z): those far enough for their
    level, or of level 0, with no such ancestor. From the top down: observers meet the chunks that have no ancestor,
    and go on to children by an equality join only below a chunk too near to be rendered, so that no
    observer meets the fine chunks of a region that a coarse one stands for."""
    tops, edges = nearest_ancestors(chunks, spec)
    centre, radius = bounding_sphere(spec, F.col("lod"))
    fit = (F.col("lod") == 0) | ((centre - Vec.of(*axes(spec))).norm() / radius > detail)
    seen = observers.select("id", *axes(spec))
    columns = ["id", "lod", *keys(spec)]
    levels, open_ = [], None
    for lod in range(spec.root_lod, -1, -1):
        visited = tops.df.where(F.col("lod") == lod).crossJoin(seen)  # roots are few
        if open_ is not None:
            below = edges.df.where(F.col("lod") == lod).join(open_, ["plod", *[f"p{k}" for k in keys(spec)]])
            visited = visited.unionByName(below.select("lod", *keys(spec), "id", *axes(spec)))
        level = Table(visited.withColumn("fit", fit))
        levels.append(level)
        near = level.df.where("not fit").select("id", *axes(spec), F.col("lod").alias("plod"), *[F.col(k).alias(f"p{k}") for k in keys(spec)])
        open_ = near if open_ is None else open_.unionByName(near)
    return reduce(DataFrame.unionByName, [t.df.where("fit").select(*columns) for t in levels])


def changes(before: DataFrame, after: DataFrame, spec: ChunkSpec) -> DataFrame:
    """(id, change, lod, key, others): Split of an old chunk into new ones below it, Merge of old ones into a
    new one above, Spawn of a new one without either."""
    on = ["id", "lod", *keys(spec)]
    gone, come = Table(before.join(after, on, "left_anti")).df, Table(after.join(before, on, "left_anti")).df
    key = F.struct("lod", *keys(spec)).alias("k")

    def under(fine: DataFrame, coarse: DataFrame) -> DataFrame:
        """(id, chunk of coarse, descendant of it in fine)."""
        parts = []
        for up in range(1, spec.root_lod + 1):
            above = parent_key(Vec.of(*keys(spec)), spec, up)
            low = fine.select("id", key, (F.col("lod") + up).alias("lod"), *[v.alias(k) for v, k in zip(above.parts, keys(spec))])
            parts.append(low.join(coarse, on))
        return reduce(DataFrame.unionByName, parts)

    falls = Table(under(come, gone)).df
    split = falls.groupBy(*on).agg(F.sort_array(F.collect_list("k")).alias("others"))
    merge = under(gone, come).groupBy(*on).agg(F.sort_array(F.collect_list("k")).alias("others"))
    below = falls.select("id", F.col("k.lod").alias("lod"), *[F.col(f"k.{k}").alias(k) for k in keys(spec)])
    spawn = come.join(below, on, "left_anti").join(merge.select(*on), on, "left_anti")
    kind = lambda df, name: df.select("id", F.lit(name).alias("change"), "lod", *keys(spec), F.col("others") if "others" in df.columns else F.expr("array()").cast(split.schema["others"].dataType).alias("others"))
    return kind(split, "Split").unionByName(kind(merge, "Merge")).unionByName(kind(spawn, "Spawn"))


def loading_slots(nodes: DataFrame, observers: DataFrame, spec: ChunkSpec, budget: int, top_down: bool = False) -> DataFrame:
    """The `budget` pending chunks of level 0 nearest to each observer, and with them all pending coarser ones that
    have no pending chunk of a lower level below them, which the budget doesn't count: (id, lod, key, dist). nodes
    have a state bitmask; only those whose loading bit is set are pending. top_down: coarser ones come whether or not
    chunks below them are pending. The budget is taken in each part of the pending chunks first, so that a
    task keeps `budget` rows an observer and no sort sees all of them."""
    from pyspark.sql import Window

    pending = nodes.where(F.expr(f"getbit(state, {LOADING})") == 1).select("lod", *keys(spec))
    coarse = pending.where("lod > 0")
    if not top_down:
        waiting = None
        for up in range(1, spec.root_lod + 1):
            above = parent_key(Vec.of(*keys(spec)), spec, up)
            chain = pending.select((F.col("lod") + up).alias("lod"), *above.named(*keys(spec)))
            waiting = chain if waiting is None else waiting.unionByName(chain)
        coarse = coarse if waiting is None else coarse.join(waiting.distinct(), ["lod", *keys(spec)], "left_anti")
    centre, _ = bounding_sphere(spec, F.col("lod"))
    dist = (centre - Vec.of(*axes(spec))).norm()
    seen = observers.select("id", *axes(spec))
    near = pending.where("lod = 0").crossJoin(seen).withColumn("dist", dist)
    part = near.withColumn("__p", F.spark_partition_id())
    order = [F.col("dist"), *[F.col(k) for k in keys(spec)]]
    for by in (["id", "__p"], ["id"]):
        part = part.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= budget).drop("r")
    columns = ["id", "lod", *keys(spec), "dist"]
    return part.select(*columns).unionByName(coarse.crossJoin(seen).withColumn("dist", dist).select(*columns))


def set_bit(state: Column, bit: int, on: bool = True) -> Column:
    mask = F.lit(1 << bit).cast("long")
    return state.bitwiseOR(mask) if on else state.bitwiseAND(F.bitwise_not(mask))


def mark_for_loading(nodes: DataFrame, wanted: DataFrame, spec: ChunkSpec) -> DataFrame:
    """nodes (lod, key, state) with the wanted keys and all their ancestors pending; missing ones are made."""
    parts = []
    for lod_up in range(spec.root_lod + 1):
        above = parent_key(Vec.of(*keys(spec)), spec, lod_up) if lod_up else Vec.of(*keys(spec))
        parts.append(wanted.where(F.col("lod") + lod_up <= spec.root_lod).select((F.col("lod") + lod_up).alias("lod"), *above.named(*keys(spec))))
    chain = reduce(DataFrame.unionByName, parts).distinct().withColumn("__m", F.lit(True))
    joined = nodes.select("lod", *keys(spec), "state").join(chain, ["lod", *keys(spec)], "full_outer")
    old = F.coalesce("state", F.lit(0).cast("long"))
    return joined.select("lod", *keys(spec), F.when(F.col("__m"), set_bit(old, LOADING)).otherwise(old).alias("state"))


def inherited_state(wanted: DataFrame, nodes: DataFrame, spec: ChunkSpec) -> DataFrame:
    """wanted (lod, key) with the state of the node or, where it is missing, of its nearest ancestor."""
    found = None
    for up in range(spec.root_lod + 1):
        above = parent_key(Vec.of(*keys(spec)), spec, up) if up else Vec.of(*keys(spec))
        keyed = wanted.select("lod", *keys(spec), F.lit(up).alias("up"), (F.col("lod") + up).alias("l"), *[v.alias(f"p{k}") for v, k in zip(above.parts, keys(spec))])
        hit = keyed.join(nodes.select(F.col("lod").alias("l"), *[F.col(k).alias(f"p{k}") for k in keys(spec)], "state"), ["l", *[f"p{k}" for k in keys(spec)]])
        hit = hit.select("lod", *keys(spec), "up", "state")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("lod", *keys(spec)).agg(F.min_by("state", "up").alias("state"))
    return wanted.join(best, ["lod", *keys(spec)], "left")


def subtree(chunks: DataFrame, spec: ChunkSpec, lod: int, key) -> tuple[DataFrame, DataFrame]:
    """(nodes of a subtree, children before parents by `order`; the rest of the table)."""
    under = F.lit(False)
    for low in range(lod + 1):
        above = parent_key(Vec.of(*keys(spec)), spec, lod - low) if lod > low else Vec.of(*keys(spec))
        under = under | ((F.col("lod") == low) & above.equals(Vec(*key)))
    return chunks.where(under).withColumn("order", F.col("lod")), chunks.where(~under)


def children(chunks: DataFrame, spec: ChunkSpec) -> DataFrame:
    """(parent's key, corner, child's key) for every present child of present chunks."""
    p = Vec.of(*keys(spec))
    out = chunks.where("lod > 0").select("lod", *keys(spec)).withColumn("corner", F.explode(F.array(*[F.lit(i) for i in range(1 << spec.dim)])))
    kid = child_key(p, F.col("corner"), spec)
    out = out.withColumns({**{f"child_{k}": v for k, v in zip(keys(spec), kid.parts)}, "l": F.col("lod") - 1})
    there = chunks.select(F.col("lod").alias("l"), *[F.col(k).alias(f"child_{k}") for k in keys(spec)])
    return out.join(there, ["l", *[f"child_{k}" for k in keys(spec)]], "left_semi").select("lod", *keys(spec), "corner", *[f"child_{k}" for k in keys(spec)])
