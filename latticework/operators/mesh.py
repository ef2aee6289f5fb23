"""Meshes as tables: surface nets, greedy quads, height maps, and buffers from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import points as P
from latticework.functions.points import Vec
from latticework.model import AXES, KEYS, ChunkSpec, Extent
from latticework.operators.maps import in_extent
from latticework.operators.neighbours import halo, visible_faces


def cells(samples: DataFrame, extent: Extent, value: str = "v") -> DataFrame:
    """(x, y, z, c): for each cell whose eight corners lie in the extent, their values by 0bZYX. A sample
    is sent to the cells that it is a corner of and gathered there: one shuffle, whatever the shape."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(-d).cast("long").alias(a) for a, d in zip(AXES, o)]) for i, o in enumerate(P.CORNERS_3)])
    sent = samples.where(in_extent(extent)).select(*AXES, F.col(value).cast("double").alias("__v")).withColumn("m", F.explode(moves))
    sent = sent.select(*[(F.col(a) + F.col(f"m.{a}")).alias(a) for a in AXES], "m.i", "__v").where(in_extent(Extent(extent.minimum, tuple(s - 1 for s in extent.shape))))
    gathered = sent.groupBy(*AXES).agg(F.array_sort(F.collect_list(F.struct("i", "__v"))).alias("c"))
    return gathered.where(F.size("c") == 8).select(*AXES, F.transform("c", lambda s: s["__v"]).alias("c"))


def vertices(cell_table: DataFrame, voxel_size: float = 1.0) -> DataFrame:
    """(x, y, z, px, py, pz, nx, ny, nz): a vertex in each cell with corners of either sign, at the mean
    of the crossings of its edges; the normal is the gradient there, interpolated from the edges."""
    c = [F.get("c", F.lit(i)) for i in range(8)]
    below = sum((F.when(v < 0, 1).otherwise(0) for v in c), F.lit(0))
    sums = [F.lit(0.0)] * 3
    n = F.lit(0)
    for i, j in P.EDGES_3:
        crossed = (c[i] < 0) != (c[j] < 0)
        t = F.try_divide(c[i], c[i] - c[j])
        for a in range(3):
            at = F.lit(float(i >> a & 1)) + t * float((j >> a & 1) - (i >> a & 1))
            sums[a] = sums[a] + F.when(crossed, at).otherwise(0.0)
        n = n + F.when(crossed, 1).otherwise(0)
    own = cell_table.where((below > 0) & (below < 8)).withColumns({f"s{a}": s / n for a, s in zip(AXES, sums)})
    t = [F.col(f"s{a}") for a in AXES]
    grad = []
    for a in range(3):
        b, d = [k for k in range(3) if k != a]
        parts = F.lit(0.0)
        for i, j in P.EDGES_3:
            if j - i == 1 << a:
                wb = t[b] if i >> b & 1 else 1 - t[b]
                wd = t[d] if i >> d & 1 else 1 - t[d]
                parts = parts + (c[j] - c[i]) * wb * wd
        grad.append(parts)
    return own.select(*AXES, *[(F.lit(voxel_size) * (F.col(a) + F.col(f"s{a}") + 0.5)).alias(f"p{a}") for a in AXES], *[g.alias(f"n{a}") for g, a in zip(grad, AXES)])


def surface_quads(samples: DataFrame, extent: Extent, value: str = "v") -> DataFrame:
    """(axis, x, y, z, inward): edges of the lattice along an axis whose ends differ in sign, with four
    cells around; inward if the first end is negative. Edges on the least planes across, and beyond
    the last cells, belong to neighbouring meshes."""
    own = samples.where(in_extent(extent)).select(*AXES, (F.col(value) < 0).alias("neg"))
    ahead = F.array(*[F.struct(F.lit("xyz"[a]).alias("axis"), *[F.lit(int(a == b)).cast("long").alias(n) for b, n in enumerate(AXES)]) for a in range(3)])
    edges = own.withColumn("d", F.explode(ahead)).select(*AXES, "neg", "d.axis", *[(F.col(n) + F.col(f"d.{n}")).alias(f"n{n}") for n in AXES])
    ends = own.select(*[F.col(n).alias(f"n{n}") for n in AXES], F.col("neg").alias("other"))
    inner = F.lit(True)
    for a, n in enumerate(AXES):
        inner = inner & (F.col(n) < extent.maximum[a]) & F.when(F.col("axis") == "xyz"[a], F.col(n) != extent.maximum[a] - 1).otherwise(F.col(n) != extent.minimum[a])
    return edges.where(inner).join(ends, ["nx", "ny", "nz"]).where("neg <> other").select("axis", *AXES, F.col("neg").alias("inward"))


#: Blocks whose quads are found at once, from their samples and those one around.
BLOCK = ChunkSpec((16, 16, 16))
#: Axes across each axis, in order.
_ACROSS = [(1, 2), (2, 0), (0, 1)]
_PLACES = [f"p{k}{a}" for k in range(4) for a in AXES]


def _vertices_of(c: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Vertices inside cells, from values and whether they are known, by corner and cell: vertices() term by term."""
    sums, n = np.zeros((3, c.shape[1])), np.zeros(c.shape[1], dtype=np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i, j in P.EDGES_3:
            crossed = ((c[i] < 0) != (c[j] < 0)) & known[i] & known[j]
            t = c[i] / (c[i] - c[j])
            for a in range(3):
                sums[a] += np.where(crossed, float(i >> a & 1) + t * float((j >> a & 1) - (i >> a & 1)), 0.0)
            n += crossed
        return sums / n


def _block_quads(key: list[int], at: np.ndarray, v: np.ndarray, valid: np.ndarray, extent: Extent, voxel_size: float) -> Iterator[pa.RecordBatch]:
    """Quads of the edges that begin in a block, and the vertices of the four cells around each. Arrays are by (z, y, x)
    and begin one before the block."""
    side = tuple(s + 2 for s in reversed(BLOCK.shape))
    there, known, grid = np.zeros(side, bool), np.zeros(side, bool), np.zeros(side)
    there.flat[at], known.flat[at], grid.flat[at] = True, valid, np.where(valid, v, 0.0)
    negative = known & (grid < 0)
    part = lambda g, o: g[tuple(slice(d, d + n - 1) for d, n in zip(reversed(o), side))]
    below = sum(part(negative, o).astype(np.int8) for o in P.CORNERS_3)
    mixed = np.logical_and.reduce([part(there, o) for o in P.CORNERS_3]) & (below > 0) & (below < 8)
    inside = _vertices_of(*(np.stack([part(g, o)[mixed] for o in P.CORNERS_3]) for g in (grid, known)))
    places = [voxel_size * ((low - 1 + where).astype(float) + s + 0.5) for low, where, s in zip(key, reversed(np.nonzero(mixed)), inside)]
    number = np.full(mixed.shape, -1)
    number[mixed] = np.arange(inside.shape[1])
    own = lambda g, o=(0, 0, 0): g[tuple(slice(1 + d, 1 + d + n) for d, n in zip(reversed(o), reversed(BLOCK.shape)))]
    for axis, across in enumerate(_ACROSS):
        ahead = tuple(int(a == axis) for a in range(3))
        found = own(known) & own(known, ahead) & (own(negative) != own(negative, ahead))
        for a in range(3):
            x = key[a] + np.arange(BLOCK.shape[a])
            kept = (x < extent.maximum[a]) & (x != (extent.maximum[a] - 1 if a == axis else extent.minimum[a]))
            found = found & kept.reshape([-1 if 2 - a == d else 1 for d in range(3)])
        cells = [own(number, tuple(-int(bool(k & 1 and a == across[0]) or bool(k & 2 and a == across[1])) for a in range(3))) for k in range(4)]
        for c in cells:
            found = found & (c >= 0)
        columns = [low + where for low, where in zip(key, reversed(np.nonzero(found)))] + [own(negative)[found]]
        columns += [p[c[found]] for c in cells for p in places]
        yield pa.RecordBatch.from_arrays([pa.repeat("xyz"[axis], len(columns[0])), *map(pa.array, columns)], names=["axis", *AXES, "inward", *_PLACES])


def _net(samples: DataFrame, extent: Extent, voxel_size: float, value: str) -> DataFrame:
    """(axis, x, y, z, inward, positions p0.. of the four cells around, long_way): quads of which all four cells have
    a vertex. Each block gets its samples and those around it in one shuffle and is meshed by itself."""
    own = samples.where(in_extent(extent)).select(*[F.col(a).cast("long").alias(a) for a in AXES], F.col(value).cast("double").alias("__v"))
    local = Vec.of(*AXES) - Vec.of(*KEYS) + 1
    sent = halo(own, BLOCK).select(*KEYS, P.stride(local, tuple(s + 2 for s in BLOCK.shape)).cast("int").alias("__at"), "__v")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        v = rows.column("__v")
        found = _block_quads([k.as_py() for k in key], rows.column("__at").to_numpy(), v.to_numpy(), v.is_valid().to_numpy(), extent, voxel_size)
        return pa.Table.from_batches(list(found))

    quads = sent.groupBy(*KEYS).applyInArrow(run, "axis string, x long, y long, z long, inward boolean, " + ", ".join(f"{p} double" for p in _PLACES))
    quads = quads.select("axis", *AXES, "inward", *[F.struct(*[F.col(f"p{k}{a}").alias(f"p{a}") for a in AXES]).alias(f"p{k}") for k in range(4)])

    def apart(i, j):
        return sum(((F.col(f"p{i}.{n}") - F.col(f"p{j}.{n}")) ** 2 for n in ("px", "py", "pz")), F.lit(0.0))

    return quads.withColumn("long_way", apart(0, 3) < apart(1, 2))


def _triangles(net: DataFrame, prefix: str) -> Column:
    """Two triangles a quad as structs a, b, c of what it has for its cells, split along its shorter diagonal, wound outwards."""

    def tri(i, j, k):
        return F.struct(*[F.col(f"{prefix}{m}").alias(n) for m, n in zip((i, j, k), "abc")])

    return (
        F.when(net["long_way"] & F.col("inward"), F.array(tri(0, 1, 3), tri(0, 3, 2)))
        .when(net["long_way"], F.array(tri(0, 3, 1), tri(0, 2, 3)))
        .when(F.col("inward"), F.array(tri(1, 3, 2), tri(1, 2, 0)))
        .otherwise(F.array(tri(1, 2, 3), tri(1, 0, 2)))
    )


def surface_nets(samples: DataFrame, extent: Extent, voxel_size: float = 1.0, value: str = "v") -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles): triangles are (axis, x, y, z of their edge, t, three structs of cells a, b,
    c), two a quad, split along its shorter diagonal, wound outwards."""
    points = vertices(cells(samples, extent, value), voxel_size)
    out = _net(samples, extent, voxel_size, value)
    for k in range(4):
        moved = [F.col(n) - sum((F.when(F.col("axis") == "xyz"[ax], int(bool(k & 1 and a == b) or bool(k & 2 and a == d))).otherwise(0) for ax, (b, d) in enumerate(_ACROSS)), F.lit(0)) for a, n in enumerate(AXES)]
        out = out.withColumn(f"c{k}", F.struct(*[m.cast("long").alias(n) for m, n in zip(moved, AXES)]))
    return points, out.select("axis", *AXES, F.posexplode(_triangles(out, "c")).alias("t", "tri")).select("axis", *AXES, "t", "tri.a", "tri.b", "tri.c")


def flat_surface_nets(samples: DataFrame, extent: Extent, voxel_size: float = 1.0, value: str = "v") -> DataFrame:
    """flat_shaded() of surface_nets(), without a join: quads come with the positions of their corners."""
    out = _net(samples, extent, voxel_size, value)
    out = out.select("axis", *AXES, F.posexplode(_triangles(out, "p")).alias("t", "tri"))
    return _flat(out.select("axis", *AXES, "t", *[F.col(f"tri.{n}").alias(f"at_{n}") for n in "abc"]))


def greedy_quads(voxels: DataFrame, value: str = "m", opaque: str = "opaque") -> DataFrame:
    """(axis, sign, x, y, z, width, height, value): visible faces of equal value merged to rectangles, u
    runs first and then v, taken in (v, u) order; u, v follow the normal cyclically. Slices are
    independent, so each is a group of its own."""
    faces = visible_faces(voxels, opaque).join(voxels.select(*AXES, F.col(value).alias("value")), list(AXES))
    normal = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
    u = F.when(F.col("axis") == "x", F.col("y")).when(F.col("axis") == "y", F.col("z")).otherwise(F.col("x"))
    v = F.when(F.col("axis") == "x", F.col("z")).when(F.col("axis") == "y", F.col("x")).otherwise(F.col("y"))
    slices = faces.select("axis", "sign", normal.alias("n"), u.alias("u"), v.alias("v"), "value")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {(b, a): c for a, b, c in zip(pdf.u, pdf.v, pdf.value)}
        rows = []
        for v, u in sorted(left):
            if (v, u) not in left:
                continue
            c, w, h = left[(v, u)], 1, 1
            while left.get((v, u + w)) == c:
                w += 1
            while all(left.get((v + h, k)) == c for k in range(u, u + w)):
                h += 1
            for b in range(v, v + h):
                for a in range(u, u + w):
                    del left[(b, a)]
            rows.append((u, v, w, h, c))
        out = pd.DataFrame(rows, columns=["u", "v", "width", "height", "value"])
        return out.assign(axis=pdf.axis.iloc[0], sign=pdf.sign.iloc[0], n=pdf.n.iloc[0])[["axis", "sign", "n", "u", "v", "width", "height", "value"]]

    kind = slices.schema["value"].dataType.simpleString()
    merged = slices.groupBy("axis", "sign", "n").applyInPandas(merge, f"axis string, sign int, n long, u long, v long, width long, height long, value {kind}")
    ax = F.col("axis")
    x = F.when(ax == "x", F.col("n")).when(ax == "y", F.col("v")).otherwise(F.col("u"))
    y = F.when(ax == "x", F.col("u")).when(ax == "y", F.col("n")).otherwise(F.col("v"))
    z = F.when(ax == "x", F.col("v")).when(ax == "y", F.col("u")).otherwise(F.col("n"))
    return merged.select("axis", "sign", x.alias("x"), y.alias("y"), z.alias("z"), "width", "height", "value")


def quad_corners(quads: DataFrame) -> DataFrame:
    """quads with a row for each corner k = 0bVU: position and texture coordinates. Faces of positive sign
    lie on the far side of their voxels."""
    out = quads.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    du, dv = F.col("width") * F.col("k").bitwiseAND(1), F.col("height") * F.shiftright("k", 1)
    far = F.when(F.col("sign") > 0, 1).otherwise(0)
    ax = F.col("axis")
    px = F.col("x") + F.when(ax == "x", far).when(ax == "y", dv).otherwise(du)
    py = F.col("y") + F.when(ax == "x", du).when(ax == "y", far).otherwise(dv)
    pz = F.col("z") + F.when(ax == "x", dv).when(ax == "y", du).otherwise(far)
    return out.withColumns({"px": px, "py": py, "pz": pz, "tu": du, "tv": dv})


def quad_indices(sign: Column, first: Column) -> Column:
    """Six indices of a quad whose corners begin at `first`, counter-clockwise seen from its normal."""
    positive, negative = [0, 1, 2, 1, 3, 2], [0, 2, 1, 1, 2, 3]
    return F.when(sign > 0, F.array(*[first + i for i in positive])).otherwise(F.array(*[first + i for i in negative]))


def height_vertices(heights: DataFrame, extent: Extent) -> DataFrame:
    """(x, y, h, nx, ny, nz, vertex): interior points of a height map (x, y, h), with central-difference
    normals (not normalised) and row-major vertex numbers, which follow from the extent alone."""
    own = heights.where(in_extent(extent)).select("x", "y", "h")
    moves = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(-d).cast("long").alias(a) for a, d in zip("xy", o)]) for i, o in enumerate([(0, 0), *P.VON_NEUMANN_2])])
    sent = own.withColumn("m", F.explode(moves)).select((F.col("x") + F.col("m.x")).alias("x"), (F.col("y") + F.col("m.y")).alias("y"), "m.i", "h")
    inner = extent.padded(-1)
    at = {n: F.max(F.when(F.col("i") == i, F.col("h"))) for i, n in enumerate(("h", "l", "r", "b", "t"))}
    # five values make a vertex
    near = sent.where(in_extent(inner)).groupBy("x", "y").agg(*[v.alias(n) for n, v in at.items()]).where("h is not null and l is not null and r is not null and b is not null and t is not null")
    number = (F.col("y") - inner.minimum[1]) * inner.shape[0] + F.col("x") - inner.minimum[0]
    return near.select("x", "y", "h", (-(F.col("r") - F.col("l")) / 2).alias("nx"), F.lit(1.0).alias("ny"), (-(F.col("t") - F.col("b")) / 2).alias("nz"), number.alias("vertex"))


def height_triangles(points: DataFrame, extent: Extent) -> DataFrame:
    """(x, y, t, a, b, c): two triangles a cell of four vertices."""
    w = extent.padded(-1).shape[0]
    moves = F.array(*[F.struct(*[F.lit(-d).cast("long").alias(a) for a, d in zip("xy", o)]) for o in P.CORNERS_2])
    cell = points.select("x", "y").withColumn("m", F.explode(moves)).groupBy((F.col("x") + F.col("m.x")).alias("x"), (F.col("y") + F.col("m.y")).alias("y")).agg(F.count("*").alias("n")).where("n = 4")
    inner = extent.padded(-1)
    v = (F.col("y") - inner.minimum[1]) * w + F.col("x") - inner.minimum[0]
    tris = F.array(F.struct(v.alias("a"), (v + w).alias("b"), (v + 1).alias("c")), F.struct((v + 1).alias("a"), (v + w).alias("b"), (v + w + 1).alias("c")))
    return cell.select("x", "y", F.posexplode(tris).alias("t", "s")).select("x", "y", "t", "s.a", "s.b", "s.c")


def append(meshes: DataFrame, by: str, count: str) -> DataFrame:
    """meshes (a row each, with its number of vertices) with what its indices move by when they are
    put together in the order of `by`: a prefix sum over a row a mesh, not over vertices."""
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return meshes.withColumn("first", F.coalesce(F.sum(count).over(before), F.lit(0)))


def flat_shaded(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(triangle columns, k, position, normal): three vertices of its own for each triangle, all with its
    cross-product normal."""
    place = points.select(F.struct(*AXES).alias("cell"), "px", "py", "pz")
    out = triangles
    for n in "abc":
        at = place.select(F.col("cell").alias(n), F.struct("px", "py", "pz").alias(f"at_{n}"))
        out = out.join(at, n)
    return _flat(out)


def _flat(out: DataFrame) -> DataFrame:
    def side(n, m):
        return Vec(*[F.col(f"at_{n}.{p}") - F.col(f"at_{m}.{p}") for p in ("px", "py", "pz")])

    normal = side("b", "a").cross(side("c", "a"))
    corners = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"at_{n}").alias("p")) for k, n in enumerate("abc")])
    out = out.withColumns(dict(zip(("nx", "ny", "nz"), normal.parts))).withColumn("s", F.explode(corners))
    return out.select("axis", *AXES, "t", "s.k", "s.p.px", "s.p.py", "s.p.pz", "nx", "ny", "nz")
