"""Rays, flood fill and paths."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import points as P
from latticework.functions.points import Vec
from latticework.model import AXES, ChunkSpec, Extent
from latticework.operators.maps import chunk_min, in_extent, keys
from latticework.operators.plumbing import Table


def walk(start, velocity, n: int, truncate: bool = False) -> Iterator[tuple[int, ...]]:
    """The first n cells that a ray meets, in single precision; of equal crossings the later axis goes
    first. The start is floored, or cut towards zero."""
    one = np.float32
    start, velocity = [one(c) for c in start], [one(v) for v in velocity]
    cell = [int(c) if truncate else math.floor(c) for c in start]
    step = [1 if v >= 0 else -1 for v in velocity]
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = [one(1) / abs(v) for v in velocity]
        edge = [one(c + (1 if s > 0 else 0)) for c, s in zip(cell, step)]
        crossing = [(e - c) / v if v != 0 else one(np.inf) for e, c, v in zip(edge, start, velocity)]
    for _ in range(n):
        yield tuple(cell)
        axis = len(cell) - 1
        for a in range(len(cell) - 2, -1, -1):
            if crossing[a] < crossing[axis]:
                axis = a
        cell[axis] += step[axis]
        crossing[axis] = crossing[axis] + delta[axis]


def ray_cells(rays: DataFrame, n: int, dim: int = 3, truncate: bool = False) -> DataFrame:
    """(ray_id, step, x, y, z) of rays (ray_id, sx, .., vx, ..): walk() for all rays of a batch at once."""
    names = AXES[:dim]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, speed = (np.stack([batch.column(f"{k}{a}").to_numpy(zero_copy_only=False) for a in names], axis=1).astype(np.float32) for k in "sv")
            cell = (np.trunc(start) if truncate else np.floor(start)).astype(np.int64)
            step = np.where(speed >= 0, 1, -1)
            with np.errstate(divide="ignore", invalid="ignore"):
                delta = np.float32(1) / np.abs(speed)
                crossing = np.where(speed != 0, ((cell + (step > 0)).astype(np.float32) - start) / speed, np.float32(np.inf))
            found, at = np.empty((n, *cell.shape), dtype=np.int64), np.arange(len(cell))
            for i in range(n):
                found[i] = cell
                # of equal crossings the later axis goes first
                axis = dim - 1 - crossing[:, ::-1].argmin(axis=1)
                cell[at, axis] += step[at, axis]
                crossing[at, axis] += delta[at, axis]
            ids = np.tile(batch.column("ray_id").to_numpy(), n)
            columns = [ids, np.repeat(np.arange(n, dtype=np.int32), len(cell)), *found.reshape(-1, dim).T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ray_id", "step", *names])

    return rays.mapInArrow(run, "ray_id long, step int, " + ", ".join(f"{a} long" for a in names))


#: What a ray's hit depends on.
_RAY = [*(f"{k}{a}" for k in "sv" for a in AXES), "max_toi"]


def _on_path(rays: DataFrame, voxels: DataFrame, spec: ChunkSpec, radius: float) -> DataFrame:
    """Distinct rays x voxels in chunks that the ray's path, thickened, passes: points along each ray, half a
    chunk apart, name the chunks around it; then voxels join by chunk. The planner takes the exploded
    rays to be as small as the table they come from, so the join is told not to broadcast them."""
    once = rays.select(*_RAY).distinct().repartition(int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = min(spec.shape) / 2
    length = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    many = F.ceil(length * F.col("max_toi") / step).cast("int")
    along = once.withColumn("__t", F.explode(F.sequence(F.lit(0), many)))
    # a ray that doesn't move has its start alone
    t = F.coalesce(F.least(F.try_divide(F.col("__t") * step, length), F.col("max_toi")), F.lit(0.0))
    reach = radius + step + 1
    at = along
    for a, k, s in zip(AXES, keys(spec), spec.shape):
        c = F.col(f"s{a}") + t * F.col(f"v{a}")
        low, high = F.floor((c - reach) / s).cast("long"), F.floor((c + reach) / s).cast("long")
        at = at.withColumn(k, F.explode(F.sequence(low, high))).withColumn(k, F.col(k) * s)
    wanted = at.drop("__t").distinct()
    keyed = voxels.select(*AXES).withColumns(dict(zip(keys(spec), chunk_min(Vec.of(*AXES), spec).parts)))
    return wanted.hint("merge").join(keyed, list(keys(spec))).drop(*keys(spec))


def _first(rays: DataFrame, hits: DataFrame, toi: Column) -> DataFrame:
    """(ray_id, x, y, z, toi) of the least (toi, z, y, x) among the hits of each ray."""
    best = hits.groupBy(*_RAY).agg(F.min(F.struct(toi.alias("toi"), "z", "y", "x")).alias("b"))
    each = rays.select("ray_id", *_RAY).hint("merge").join(best, _RAY).groupBy("ray_id").agg(F.min("b").alias("b"))
    return each.select("ray_id", "b.x", "b.y", "b.z", "b.toi")


def cast_rays(rays: DataFrame, voxels: DataFrame, spec: ChunkSpec = ChunkSpec((16, 16, 16))) -> DataFrame:
    """The first voxel that each ray (ray_id, s, v, max_toi) meets: (ray_id, x, y, z, toi). Slab test in
    Columns, then the least time of impact a ray; equal times go to the least (z, y, x). Equal rays are
    cast once."""
    near, far = F.lit(0.0), F.col("max_toi").cast("double")
    for a in AXES:
        s, v, low = F.col(f"s{a}"), F.col(f"v{a}"), F.col(a)
        t0, t1 = F.try_divide(low - s, v), F.try_divide(low + 1 - s, v)
        inside = (s >= low) & (s <= low + 1)
        near = F.greatest(near, F.when(v != 0, F.least(t0, t1)).when(inside, F.lit(0.0)).otherwise(F.lit(float("inf"))))
        far = F.least(far, F.when(v != 0, F.greatest(t0, t1)).when(inside, F.col("max_toi")).otherwise(F.lit(float("-inf"))))
    hits = _on_path(rays, voxels, spec, 0.0).withColumn("toi", near).where(near <= far)
    return _first(rays, hits, F.col("toi"))


#: Edges of a cube as (axis, corner whose coordinate on it is 0), and its corners.
_EDGES = [(a, tuple(o if k != a else 0 for k, o in enumerate((b & 1, b >> 1 & 1, b >> 2 & 1)))) for a in range(3) for b in range(8) if not b >> a & 1]
_CORNERS = [(b & 1, b >> 1 & 1, b >> 2 & 1) for b in range(8)]


def ball_toi(start: np.ndarray, velocity: np.ndarray, low: np.ndarray, radius: float) -> np.ndarray:
    """Times at which moving balls first touch the unit cubes at low, a row each; inf if never. A cube grown by
    a ball is three boxes, twelve cylinders about its edges and eight balls about its corners, so the time
    is the least of those at which the centre enters one of them."""
    s, v = np.asarray(start, float) - low, np.asarray(velocity, float)
    best = np.full(len(s), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for grown in range(3):
            near, far = np.zeros(len(s)), np.full(len(s), np.inf)
            for a in range(3):
                lo, hi = (-radius, 1 + radius) if a == grown else (0.0, 1.0)
                t0, t1 = (lo - s[:, a]) / v[:, a], (hi - s[:, a]) / v[:, a]
                still, inside = v[:, a] == 0, (s[:, a] >= lo) & (s[:, a] <= hi)
                near = np.maximum(near, np.where(still, np.where(inside, 0, np.inf), np.minimum(t0, t1)))
                far = np.minimum(far, np.where(still, np.where(inside, np.inf, -np.inf), np.maximum(t0, t1)))
            best = np.minimum(best, np.where(near <= far, near, np.inf))
        for along, corner in [*_EDGES, *((None, c) for c in _CORNERS)]:
            p = s - np.array(corner, float)
            across = [a for a in range(3) if a != along]
            a2 = (v[:, across] ** 2).sum(1)
            b2 = (p[:, across] * v[:, across]).sum(1)
            c2 = (p[:, across] ** 2).sum(1) - radius**2
            root = b2 * b2 - a2 * c2
            t = np.where(c2 <= 0, 0.0, np.where((root >= 0) & (b2 < 0), (-b2 - np.sqrt(np.maximum(root, 0))) / a2, np.inf))
            if along is not None:  # within the edge; beyond it the corners decide
                at = p[:, along] + np.where(np.isfinite(t), t, 0) * v[:, along]
                t = np.where((at >= 0) & (at <= 1), t, np.inf)
            best = np.minimum(best, np.where(np.isnan(t), np.inf, t))
    return best


def cast_balls(rays: DataFrame, voxels: DataFrame, radius: float, spec: ChunkSpec = ChunkSpec((16, 16, 16))) -> DataFrame:
    """The first voxel that a ball moving along each ray touches: (ray_id, x, y, z, toi). Only voxels whose box,
    grown by the radius, the ray meets are looked at. Equal rays are cast once."""
    near = _on_path(rays, voxels, spec, radius)
    meets, low, high = F.lit(True), F.lit(0.0), F.col("max_toi").cast("double")
    for a in AXES:
        s, v, from_, to = F.col(f"s{a}"), F.col(f"v{a}"), F.col(a) - radius, F.col(a) + 1 + radius
        t0, t1 = F.try_divide(from_ - s, v), F.try_divide(to - s, v)
        meets = meets & ((v != 0) | ((s >= from_) & (s <= to)))
        low = F.greatest(low, F.when(v != 0, F.least(t0, t1)).otherwise(0.0))
        high = F.least(high, F.when(v != 0, F.greatest(t0, t1)).otherwise(F.lit(float("inf"))))
    near = near.where(meets & (low <= high + 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, v, p = (np.stack([batch.column(f"{k}{a}").to_numpy(zero_copy_only=False) for a in AXES], axis=1).astype(np.float64) for k in ("s", "v", ""))
            toi = ball_toi(s, v, p, radius)
            hit = pa.array(toi <= batch.column("max_toi").to_numpy(zero_copy_only=False))
            columns = [*(batch.column(c) for c in (*_RAY, *AXES)), pa.array(toi)]
            yield pa.RecordBatch.from_arrays([c.filter(hit) for c in columns], names=[*_RAY, *AXES, "toi"])

    kinds = ", ".join(f"{c} {near.schema[c].dataType.simpleString()}" for c in (*_RAY, *AXES))
    return _first(rays, near.select(*_RAY, *AXES).mapInArrow(run, f"{kinds}, toi double"), F.round("toi", 6))


def contact_voxel(contact: Vec, normal: Vec) -> Vec:
    """The voxel of a contact point: a quarter inwards, floored."""
    return (contact - normal * 0.25).floor()


def connected(points: DataFrame, spec: ChunkSpec = ChunkSpec((16, 16, 16)), value: str | None = None) -> DataFrame:
    """points with `component`, the least point of their 6-connected region as a struct (z, y, x); with
    value, only equal values connect. Regions inside a chunk are labelled in one pass, and chunks'
    labels are joined over their faces until nothing changes."""
    own = points.select(*AXES, *([F.col(value).alias("val")] if value else [F.lit(0).alias("val")])).withColumns(dict(zip(keys(spec), chunk_min(Vec.of(*AXES), spec).parts)))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        at = {(x, y, z): i for i, (x, y, z) in enumerate(zip(pdf.x, pdf.y, pdf.z))}
        val, parent = pdf.val.tolist(), list(range(n))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for (x, y, z), i in at.items():
            for q in ((x + 1, y, z), (x, y + 1, z), (x, y, z + 1)):
                j = at.get(q)
                if j is not None and val[i] == val[j]:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        roots = np.array([root(i) for i in range(n)])
        # rows by (z, y, x): the first of a root is its least point
        order = np.lexsort((pdf.x, pdf.y, pdf.z))
        first = np.full(n, n)
        np.minimum.at(first, roots[order], np.arange(n))
        least = order[first[roots]]
        return pdf.assign(**{f"l{a}": pdf[a].to_numpy()[least] for a in AXES})[[*AXES, "val", "lz", "ly", "lx"]]

    kind = own.schema["val"].dataType.simpleString()
    local = Table(own.groupBy(*keys(spec)).applyInPandas(label, f"x long, y long, z long, val {kind}, lz long, ly long, lx long").select(*AXES, "val", F.struct(F.col("lz").alias("z"), F.col("ly").alias("y"), F.col("lx").alias("x")).alias("label")))
    forward = P.neighbours(local.df, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    other = local.df.select(*[F.col(a).alias(f"n{a}") for a in AXES], F.col("label").alias("b"), F.col("val").alias("nval"))
    edges = Table(forward.join(other, ["nx", "ny", "nz"]).where("val = nval and label <> b").select(F.least("label", "b").alias("a"), F.greatest("label", "b").alias("b")).distinct())
    labels = Table(edges.df.select(F.col("a").alias("node")).union(edges.df.select("b")).distinct().withColumn("root", F.col("node")))
    both = edges.df.union(edges.df.select("b", "a"))
    while True:
        # least label among neighbours, then the label of that label: distances halve
        step = both.join(labels.df, both["b"] == labels.df["node"]).groupBy("a").agg(F.min("root").alias("low"))
        moved = labels.df.join(step, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = moved.select(F.col("node").alias("m"), F.col("root").alias("up"))
        after = Table(moved.join(jump, F.col("root") == F.col("m"), "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        still = after.df.join(labels.df.withColumnRenamed("root", "was"), "node").where("root <> was").isEmpty()
        labels.drop()
        labels = after
        if still:
            break
    done = local.df.join(labels.df, F.col("label") == F.col("node"), "left")
    return done.select(*AXES, *([F.col("val").alias(value)] if value else []), F.coalesce("root", "label").alias("component"))


def flood_fill(points: DataFrame, seed, extent: Extent, value: str, spec: ChunkSpec = ChunkSpec((16, 16, 16))) -> DataFrame:
    """Points of the extent 6-connected to the seed through points of the seed's value."""
    inside = points.where(in_extent(extent))
    there = inside.where((F.col("x") == seed[0]) & (F.col("y") == seed[1]) & (F.col("z") == seed[2]))
    same = inside.join(F.broadcast(there.select(F.col(value).alias("__v")).limit(1)), F.col(value) == F.col("__v"), "left_semi")
    found = connected(same, spec)
    start = found.where((F.col("x") == seed[0]) & (F.col("y") == seed[1]) & (F.col("z") == seed[2])).select("component").limit(1)
    return found.join(F.broadcast(start), "component", "left_semi").select(*AXES)


def _paths(queries: DataFrame, search, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [row for r in pdf.to_dict("records") for row in search(r)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return queries.mapInPandas(run, schema)


def _near(p, moves):
    return [tuple(a + d for a, d in zip(p, o)) for o in moves]


def astar(queries: DataFrame, costs: dict, dim: int = 3) -> DataFrame:
    """Least-cost axis-connected path of each query (query_id, s.., f..): (query_id, step, x, y, z, cost).
    costs: cost of entering each passable point; a small map, one search a row. No path: no rows."""
    sent = queries.sparkSession.sparkContext.broadcast(costs)
    names, moves = AXES[:dim], P.VON_NEUMANN_3 if dim == 3 else P.VON_NEUMANN_2

    def search(r):
        costs = sent.value
        start, finish = (tuple(int(r[f"{k}{a}"]) for a in names) for k in "sf")
        if start not in costs or finish not in costs:
            return
        least = min(costs.values())
        guess = lambda p: least * sum(abs(a - b) for a, b in zip(p, finish))
        best, came, queue = {start: 0.0}, {}, [(guess(start), 0.0, start)]
        while queue:
            _, cost, p = heapq.heappop(queue)
            if p == finish:
                path = [p]
                while path[-1] in came:
                    path.append(came[path[-1]])
                yield from ((r["query_id"], i, *q, cost) for i, q in enumerate(reversed(path)))
                return
            if cost > best[p]:
                continue
            for q in _near(p, moves):
                if q in costs and cost + costs[q] < best.get(q, math.inf):
                    best[q], came[q] = cost + costs[q], p
                    heapq.heappush(queue, (best[q] + guess(q), best[q], q))

    return _paths(queries, search, "query_id long, step int, " + ", ".join(f"{a} long" for a in names) + ", cost double")


def greedy(queries: DataFrame, passable: set, most: int = 10_000, dim: int = 3) -> DataFrame:
    """Greedy best-first path by L1 distance: (query_id, reached, step, x, y, z). Without success, the path
    to the visited point nearest the finish."""
    sent = queries.sparkSession.sparkContext.broadcast(passable)
    names, moves = AXES[:dim], P.VON_NEUMANN_3 if dim == 3 else P.VON_NEUMANN_2

    def search(r):
        start, finish = (tuple(int(r[f"{k}{a}"]) for a in names) for k in "sf")
        guess = lambda p: sum(abs(a - b) for a, b in zip(p, finish))
        came, queue, near, n = {start: None}, [(guess(start), start)], start, 0
        while queue and n < most:
            n += 1
            h, p = heapq.heappop(queue)
            if h < guess(near):
                near = p
            if p == finish:
                break
            for q in _near(p, moves):
                if q in sent.value and q not in came:
                    came[q] = p
                    heapq.heappush(queue, (guess(q), q))
        path = [near]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        yield from ((r["query_id"], near == finish, i, *q) for i, q in enumerate(reversed(path)))

    return _paths(queries, search, "query_id long, reached boolean, step int, " + ", ".join(f"{a} long" for a in names))
