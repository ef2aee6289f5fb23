"""Lattice operators on small fixtures with known results."""

import random

import pytest
from pyspark.sql import functions as F

from latticework import catalog
from latticework.functions import extents as X
from latticework.functions import fields, morton
from latticework.functions import points as P
from latticework.functions.points import Vec
from latticework.model import AXES, ChunkSpec, Extent, Orthant
from latticework.operators import clipmap, maps, mesh, neighbours, octree, pyramid, search
from latticework.sources import chunk_table, scan
from latticework.sources.vox import VoxDataSource
from latticework.streaming import observers

C16 = ChunkSpec((16, 16, 16), {"v": 0}, 2)


def points(spark, rows, ddl="x long, y long, z long"):
    return spark.createDataFrame(rows, ddl)


def as_set(df, *names):
    return {tuple(r) for r in df.select(*(names or AXES)).collect()}


def test_extents():
    a, b = Extent((0, 0, 0), (4, 4, 4)), Extent((2, -1, 3), (5, 3, 1))
    assert a.intersection(b) == Extent((2, 0, 3), (2, 2, 1)) and a.intersection(b).is_subset_of(a)
    assert a.intersection(Extent((9, 9, 9), (1, 1, 1))).is_empty()
    assert a.quasi_union(b) == Extent((0, -1, 0), (7, 5, 4))
    assert Extent.from_corners((3, 1), (0, 4)) == Extent((0, 1), (4, 4))
    assert list(Extent((0, 1), (2, 2)).points()) == [(0, 1), (1, 1), (0, 2), (1, 2)]
    assert Extent.bounding([(1, 2, 3), (-1, 5, 3)]) == Extent((-1, 2, 3), (3, 4, 1))
    with pytest.raises(ValueError):
        Extent.bounding([])
    assert Extent((0, 0, 0), (0, 5, 5)).positive() and Extent((0, 0, 0), (0, -1, 0)).positive() is None
    assert (Extent((-3, 4), (6, 2)) >> 1) == Extent((-2, 2), (3, 1))


def test_orthant_covers_and_errors():
    assert len(Orthant.covering(Extent.cube((0, 0, 0), 4), 2)) == 1 and len(Orthant.covering(Extent.cube((0, 0, 0), 4), 1)) == 8
    assert len(Orthant.covering(Extent.cube((-3, -3, -3), 2), 2)) == 1 and len(Orthant.covering(Extent.cube((-3, -3, -3), 2), 1)) == 8
    for box, why in ((Extent((0, 0), (3, 4)), "ShapeNotPow2"), (Extent((0, 0), (2, 4)), "ShapeNotCube"), (Extent((1, 0), (2, 2)), "Misaligned")):
        with pytest.raises(ValueError, match=why):
            Orthant.of(box)


def test_indexer():
    assert sorted(C16.chunk_mins(Extent((15, 15, 15), (16, 16, 16)))) == sorted((x, y, z) for x in (0, 16) for y in (0, 16) for z in (0, 16))
    assert C16.chunk_min((-1, 0, 31)) == (-16, 0, 16)
    four = ChunkSpec((4, 4, 4), {"v": 0}, 2)
    assert four.parent(0, (12, 0, 0)) == (1, (4, 0, 0)) and four.parent(1, (4, 0, 0)) == (2, (0, 0, 0))
    assert ChunkSpec((4, 8, 16), {"v": 0}).parent(0, (-4, 8, 16)) == (1, (-4, 0, 0))
    with pytest.raises(ValueError):
        ChunkSpec((3, 4, 4))


def test_morton(spark):
    low, high = -(1 << 31), (1 << 31) - 1
    rows = [(low, low, low), (high, high, high), (0, 0, 0), (-1, -1, -1), (5, -7, 9)]
    got = points(spark, rows).select(*AXES, morton.morton(Vec.of(*AXES)).alias("k"), F.hex(morton.ord_key(F.lit(2), Vec.of(*AXES))).alias("b")).collect()
    for r in got:
        assert int(r.k) == morton.key_of((r.x, r.y, r.z)) and r.b == f"02{int(r.k):024X}"
    assert int(got[0].k) == 0 and int(got[1].k) == (1 << 96) - 1
    first, last = morton.orthant_range(Orthant((0, 0, 0), 1))
    keys = {morton.key_of((x, y, z)) for x in (0, 1) for y in (0, 1) for z in (0, 1)}
    assert keys == set(range(first, last + 1))


def test_write_then_read_across_chunks(spark):
    writes = points(spark, [(-15, 0, 0, 1), (15, 15, 15, 2), (16, 0, 0, 3), (0, 16, 0, 4), (0, 0, 16, 5), (15, 0, 0, 6), (-16, -16, -16, 7)], "x long, y long, z long, v int")
    empty = maps.to_chunks(writes.where("false"), C16)
    tree = maps.set_points(empty, writes, C16)
    assert as_set(maps.get_points(writes.drop("v"), tree, C16), *AXES, "v") == as_set(writes, *AXES, "v")
    assert maps.get_points(points(spark, [(100, 0, 0), (1, 1, 1)]), tree, C16).agg(F.sum("v")).first()[0] == 0
    assert tree.count() == 6
    again = maps.set_points(tree, points(spark, [(15, 15, 15, 9)], "x long, y long, z long, v int"), C16)
    assert again.count() == 6 and maps.get_points(points(spark, [(15, 15, 15)]), again, C16).first().v == 9


def test_box_write_is_one_inside_only(spark):
    box, whole = Extent.cube((10, 10, 10), 20), Extent.cube((0, 0, 0), 40)
    empty = maps.to_chunks(points(spark, [], "x long, y long, z long, v int"), C16)
    tree = maps.fill_extent(empty, C16, box, v=1)
    read = maps.read_extent(tree, C16, whole)
    assert read.count() == 40**3 and read.agg(F.sum("v")).first()[0] == 20**3
    assert read.where(F.col("v") == 1).where(~maps.in_extent(box)).isEmpty()


def test_channels_and_ambient(spark):
    spec = ChunkSpec((16, 16, 16), {"v": 0, "c": "a"})
    empty = maps.to_chunks(points(spark, [], "x long, y long, z long, v int, c string"), spec)
    tree = maps.fill_extent(empty, spec, Extent.cube((10, 10, 10), 8), v=1, c="b")
    got = maps.read_extent(tree, spec, Extent.cube((8, 8, 8), 12)).groupBy("v", "c").count()
    assert as_set(got, "v", "c", "count") == {(0, "a", 12**3 - 8**3), (1, "b", 8**3)}
    changed, after = maps.transform(tree, spec, v=lambda c: c + 1)
    assert after.channels == {"v": 1, "c": "a"}


def test_flat_buffers_must_fit(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "values array<int>")
    with pytest.raises(Exception, match="volume"):
        scan.from_arrays(df, Extent((0, 0), (2, 2))).collect()


def test_samplers(spark):
    even = scan.func(spark, Extent.cube((0, 0, 0), 16), v=lambda p: F.when(p[0].bitwiseOR(p[1]).bitwiseOR(p[2]).bitwiseAND(F.lit(1).cast("long")) == 0, 1).otherwise(0))
    got = pyramid.sample_points(even)
    assert got.count() == 8**3 and got.agg(F.min("v")).first()[0] == 1
    spec = ChunkSpec((16, 16, 16), {"v": 127}, 3)
    tree = maps.to_chunks(scan.fill(spark, Extent.cube((0, 0, 0), 32), v=127), spec)
    chain = pyramid.mip_chain(tree, spec, 3, bits=8)
    assert as_set(chain.select("lod", F.array_min("v").alias("low"), F.array_max("v").alias("high")).distinct(), "lod", "low", "high") == {(0, 127, 127), (1, 63, 63), (2, 31, 127), (3, 15, 127)}
    with pytest.raises(ValueError):
        pyramid.mip_chain(tree, spec, 4)


def test_quantised_distances(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (5.0,)], "v double")
    assert [r[0] for r in df.select(fields.quantise(F.col("v"))).collect()] == [-127, 0, 127, 127]
    assert [r[0] for r in df.select(fields.quantise(F.col("v"), 16)).collect()] == [-32767, 0, 32767, 32767]


def test_rounding_equals_round(spark):
    rng = random.Random(3)
    # ties by their text or in binary, their neighbours, and what has no digits left
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, -1e-9, 5e-6, 1.000005, 2.675, 1.005, 0.285, 1e15 + 0.5, 12345.678905, -0.000015, 1e-300, 1e300]
    ties = [(k + 0.5) * 10.0**-5 + d for k in range(-2000, 2000, 7) for d in (0.0, 1e-12, -1e-12, 1e-17)]
    df = spark.createDataFrame([(v,) for v in odd + ties + [rng.uniform(-1e3, 1e3) for _ in range(5000)] + [rng.uniform(-1e7, 1e7) for _ in range(1000)]], "v double")
    for digits in (0, 2, 5):
        both = df.select(fields.rounded("v", digits).alias("ours"), (F.round("v", digits) + F.lit(0.0)).alias("theirs"))
        assert both.where("not (ours <=> theirs)").count() == 0


def test_octree_equals_dense_model(spark):
    rng = random.Random(1)
    cells = {(x, y, z) for x in range(16) for y in range(16) for z in range(16) if rng.random() < 0.5}
    cells |= {(x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    nodes = octree.roll_up(points(spark, sorted(cells)), 4)
    leaves = octree.branches_and_leaves(nodes, 4)
    assert as_set(octree.expand(leaves)) == cells and octree.expand(leaves).count() == len(cells)
    assert (3, 0, 0, 0) in as_set(leaves.where("is_full"), "level", *AXES)
    box = Extent((5, 0, 0), (5, 6, 6))
    inside = {p for p in Extent.cube((0, 0, 0), 32).points() if box.contains(p)}
    s = points(spark, sorted(cells))
    assert as_set(octree.add_extent(s, box)) == cells | inside and as_set(octree.subtract_extent(s, box)) == cells - inside
    assert octree.full(spark, Extent.cube((0, 0, 0), 4)).count() == 64 and octree.empty(spark).count() == 0
    with pytest.raises(ValueError):
        octree.full(spark, Extent.cube((0, 0, 0), 128))
    walk = leaves.where("level >= 2").orderBy(octree.preorder(4)).collect()
    assert walk[0].level == 4


def test_surface_of_a_cube(spark):
    solid = [(x, y, z) for x in range(1, 4) for y in range(1, 4) for z in range(1, 4)] + [(0, 0, 0)]
    got = as_set(neighbours.surface_points(points(spark, solid), Extent.cube((1, 1, 1), 3)))
    assert len(got) == 26 and (2, 2, 2) not in got


def test_sphere_surface_count(spark):
    ball = scan.solid_sphere(spark, 32).where("v = 1")
    assert neighbours.surface_points(ball, Extent.cube((-16, -16, -16), 32)).count() == 2214


def test_halo_covers_padded_chunks(spark):
    p = scan.scan(spark, Extent.cube((0, 0, 0), 8))
    got = neighbours.halo(p, ChunkSpec((4, 4, 4))).where("cx = 0 and cy = 0 and cz = 0")
    assert as_set(got) == set(Extent.cube((0, 0, 0), 5).points())


def test_ray_walks(spark):
    assert list(search.walk((0.5, 0.5, 0.5), (1.0, 0.0, 0.0), 5)) == [(i, 0, 0) for i in range(5)]
    got = list(search.walk((0.5, 0.5, 0.5), (1.0, -2.0, 3.0), 10))
    assert got[0] == (0, 0, 0) and all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(got, got[1:]))
    assert next(search.walk((-0.5, 0.0, 0.0), (1.0, 0.0, 0.0), 1)) == (-1, 0, 0) and next(search.walk((-0.5, 0.0, 0.0), (1.0, 0.0, 0.0), 1, True)) == (0, 0, 0)
    rays = spark.createDataFrame([(1, 0.5, 0.5, 1.0, 0.0)], "ray_id long, sx double, sy double, vx double, vy double")
    assert search.ray_cells(rays, 3, 2).count() == 3


RAY_DDL = "ray_id long, sx double, sy double, sz double, vx double, vy double, vz double, max_toi double"


def test_casts(spark):
    solid = points(spark, [(0, 0, 0), (0, 15, 0)])
    rays = spark.createDataFrame([(1, -1.0, 0.5, 0.5, 1.0, 0.0, 0.0, 50.0), (2, 0.5, 20.0, 0.5, 0.0, -1.0, 0.0, 50.0), (3, 5.0, 5.0, -5.0, 0.0, 0.0, 1.0, 50.0), (4, -1.0, 0.5, 0.5, 1.0, 0.0, 0.0, 0.5)], RAY_DDL)
    got = {r.ray_id: (r.x, r.y, r.z, round(r.toi, 6)) for r in search.cast_rays(rays, solid).collect()}
    assert got == {1: (0, 0, 0, 1.0), 2: (0, 15, 0, 4.0)}
    balls = {r.ray_id: (r.x, r.y, r.z, round(r.toi, 4)) for r in search.cast_balls(rays, solid, 0.5).collect()}
    assert balls == {1: (0, 0, 0, 0.5), 2: (0, 15, 0, 3.5), 4: (0, 0, 0, 0.5)}


def test_flood_fill_recolours_the_ball(spark):
    ball = scan.solid_sphere(spark, 16)
    got = search.flood_fill(ball, (0, 0, 0), Extent.cube((-8, -8, -8), 16), "v", ChunkSpec((4, 4, 4)))
    assert as_set(got) == as_set(ball.where("v = 1"))


def test_components_over_chunks(spark):
    snake = [(x, 0, 0) for x in range(-20, 20)] + [(x, 5, 5) for x in range(10)]
    got = search.connected(points(spark, snake), ChunkSpec((4, 4, 4))).groupBy("component").count()
    assert sorted(r["count"] for r in got.collect()) == [10, 40]


def test_paths(spark):
    costs = {(x, y, 0): 1.0 for x in range(5) for y in range(5) if not (x == 2 and y < 4)}
    q = spark.createDataFrame([(1, 0, 0, 0, 4, 0, 0), (2, 0, 0, 0, 2, 0, 0)], "query_id long, sx long, sy long, sz long, fx long, fy long, fz long")
    got = search.astar(q, costs).collect()
    assert {r.query_id for r in got} == {1} and got[0].cost == 12.0 and len(got) == 13
    greedy = search.greedy(q, set(costs)).collect()
    assert all(r.reached for r in greedy if r.query_id == 1) and not any(r.reached for r in greedy if r.query_id == 2)


def test_surface_net_of_a_ball_is_closed(spark):
    box = Extent.cube((-6, -6, -6), 13)
    s = scan.func(spark, box, v=lambda p: (p.norm_squared() - 10).cast("double"))
    vertices, triangles = mesh.surface_nets(s, box)
    sides = {}
    for r in triangles.collect():
        a, b, c = (tuple(t) for t in (r.a, r.b, r.c))
        for e in ((a, b), (b, c), (c, a)):
            sides[e] = sides.get(e, 0) + 1
    assert sides and all(n == 1 and sides.get(e[::-1]) == 1 for e, n in sides.items())
    # Euler's formula for a sphere
    v = {p for e in sides for p in e}
    assert len(v) - len(sides) // 2 + triangles.count() == 2 and len(v) == vertices.count()
    flat = mesh.flat_shaded(vertices, triangles)
    assert flat.count() == 3 * triangles.count()
    out = flat.select((F.col("nx") * (F.col("px") - 0.5) + F.col("ny") * (F.col("py") - 0.5) + F.col("nz") * (F.col("pz") - 0.5)).alias("d"))
    assert out.agg(F.min("d")).first()[0] > 0


def test_nets_over_blocks_need_no_join(spark):
    rng = random.Random(5)
    box = Extent((-5, 9, -3), (26, 14, 9))
    # around the edges of blocks, with gaps and unknown values, and some beyond the box
    rows = [(*p, rng.choice([None, float("nan"), 0.0, -0.0]) if rng.random() < 0.004 else rng.uniform(-1, 1)) for p in Extent((-6, 8, -4), (28, 16, 11)).points() if rng.random() < 0.97]
    s = points(spark, rows, "x long, y long, z long, v double").cache()
    vertices, triangles = mesh.surface_nets(s, box, 0.5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(triangles) and plan(triangles).count("Exchange") == 1
    flat = mesh.flat_surface_nets(s, box, 0.5)
    assert "Join" not in plan(flat) and plan(flat).count("Exchange") == 1

    # quads of which all four cells have a vertex, both from the steps that have SQL
    there = {(r.x, r.y, r.z) for r in mesh.cells(s, box).where(F.exists("c", lambda v: v < 0) & ~F.forall("c", lambda v: F.coalesce(v < 0, F.lit(False)))).collect()}
    across = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}

    def cells_of(r):
        return [tuple(int(c) - (1 if (k & 1 and a == across[r.axis][0]) or (k & 2 and a == across[r.axis][1]) else 0) for a, c in enumerate((r.x, r.y, r.z))) for k in range(4)]

    want = {(r.axis, r.x, r.y, r.z): set(cells_of(r)) for r in mesh.surface_quads(s, box).collect() if there.issuperset(cells_of(r))}
    got: dict = {}
    for r in triangles.collect():
        got.setdefault((r.axis, r.x, r.y, r.z), []).append({tuple(r.a), tuple(r.b), tuple(r.c)})
    assert {k: set.union(*v) for k, v in got.items()} == want and all(len(v) == 2 and len(v[0] & v[1]) == 2 for v in got.values()) and len(want) > 1000
    spots = {}
    for r in vertices.where("px is not null").collect():
        spots[(r.x, r.y, r.z)] = (r.px, r.py, r.pz)
    by = {}
    for r in flat.collect():
        by.setdefault((r.axis, r.x, r.y, r.z, r.t), {})[r.k] = (r.px, r.py, r.pz)
    assert len(by) == 2 * len(want)
    for r in triangles.collect():
        assert repr([by[(r.axis, r.x, r.y, r.z, r.t)][k] for k in range(3)]) == repr([spots[tuple(c)] for c in (r.a, r.b, r.c)])


def test_meshes_of_two_chunks_share_no_triangle(spark):
    whole = Extent.cube((-8, -8, -8), 17)
    s = scan.func(spark, whole, v=lambda p: (p.norm_squared() - 10).cast("double"))
    left, right = Extent((-8, -8, -8), (10, 17, 17)), Extent((0, -8, -8), (9, 17, 17))
    parts = [mesh.surface_quads(s, e) for e in (left, right)]
    union = parts[0].unionByName(parts[1])
    assert union.count() == union.distinct().count() == mesh.surface_quads(s, whole).count()


def test_greedy_quads_of_a_slab(spark):
    slab = [(x, y, 0, 1 if x < 4 else 2, True) for x in range(8) for y in range(3)]
    got = mesh.greedy_quads(spark.createDataFrame(slab, "x long, y long, z long, m int, opaque boolean"))
    top = {(r.x, r.y, r.width, r.height, r.value) for r in got.where("axis = 'z' and sign = 1").collect()}
    assert top == {(0, 0, 4, 3, 1), (4, 0, 4, 3, 2)} and got.agg(F.sum(F.col("width") * F.col("height"))).first()[0] == 2 * 24 + 2 * 8 + 2 * 3
    assert mesh.quad_corners(got).count() == 4 * got.count()
    assert got.select(mesh.quad_indices(F.col("sign"), F.lit(4)).alias("i")).first().i[0] == 4


def test_height_map_normals(spark):
    e = Extent((0, 0), (6, 5))
    h = scan.func(spark, e, h=lambda p: (p[0] + p[1]).cast("double"))
    v = mesh.height_vertices(h, e)
    assert as_set(v, "nx", "ny", "nz") == {(-1.0, 1.0, -1.0)} and v.count() == 12
    t = mesh.height_triangles(v, e)
    assert t.count() == 2 * 3 * 2 and t.agg(F.max(F.greatest("a", "b", "c"))).first()[0] == 11


def test_chunk_table_versions(spark, tmp_path):
    spec = ChunkSpec((16, 16, 16), {"v": 0})
    rows = [(0, 16, 0, 0, [1]), (0, 0, 16, 0, [2]), (0, 0, 0, 16, [3]), (0, 0, -16, 0, [4])]
    ddl = "lod int, cx long, cy long, cz long, v array<int>"
    t = chunk_table.ChunkTable(spark, f"file://{tmp_path}/t", spec)
    assert t.create(spark.createDataFrame(rows, ddl)) == 0
    got = chunk_table.read_orthant(t.read(), 0, Orthant((0, 0, 0), 5)).orderBy("morton").collect()
    assert [(r.cx, r.cy, r.cz) for r in got] == [(16, 0, 0), (0, 16, 0), (0, 0, 16)]
    one = t.snapshot()
    t.commit(chunk_table.deltas(spark.createDataFrame([(0, 16, 0, 0, [9])], ddl), spec, spark.createDataFrame([rows[1]], ddl)))
    assert {(r.cx, r.cy, tuple(r.v)) for r in t.read().collect()} == {(16, 0, (9,)), (0, 0, (3,)), (0, -16, (4,))}
    assert t.read(0).count() == 4 and t.current() == one and t.parent(one) == 0
    t.commit(chunk_table.deltas(spark.createDataFrame([(0, 16, 0, 0, [10])], ddl), spec))
    assert {tuple(r.v) for r in t.read().collect()} == {(10,), (3,), (4,)}
    t.set_current(0)
    assert t.read().count() == 4
    with pytest.raises(ValueError):
        t.commit(chunk_table.deltas(spark.createDataFrame(rows, ddl), spec))
    two = t.snapshot()
    assert two == 2 and t.parent(two) == 0 and t.read().count() == 4
    with pytest.raises(ValueError):
        t.set_current(77)


def test_vox_round_trip(spark, tmp_path):
    rows = [(0, 0, 1, 79), (1, 0, 0, 79), (2, 0, 0, 79), (2, 0, 1, 69), (2, 0, 2, 69), (1, 1, 1, None)]
    data = scan.encode_vox(spark.createDataFrame(rows, "x long, y long, z long, color_index int"), Extent.cube((0, 0, 0), 3)).first().vox
    (tmp_path / "a.vox").write_bytes(bytes(data))
    got = scan.read_vox(spark, str(tmp_path / "a.vox"), 0)
    assert as_set(got, *AXES, "color_index") == {r for r in rows if r[3]}
    assert scan.read_vox(spark, str(tmp_path / "a.vox"), 5).count() == 0
    spark.dataSource.register(VoxDataSource)
    load = lambda i: spark.read.format("vox").option("modelIndex", i).load(str(tmp_path))
    assert as_set(load(0), *AXES, "color_index") == as_set(got, *AXES, "color_index") and load(3).count() == 0
    with pytest.raises(ValueError):
        scan.encode_vox(got, Extent.cube((0, 0, 0), 256))


def test_image_round_trip(spark, tmp_path):
    e = Extent((0, 0), (4, 3))
    p = scan.func(spark, e, channels=lambda p: F.array((p[0] * 10).cast("int"), (p[1] * 20).cast("int"), F.lit(7)))
    (tmp_path / "a.ppm").write_bytes(bytes(scan.encode_image(p, e).first().image))
    got = scan.images(spark, str(tmp_path / "a.ppm"))
    assert {(r.x, r.y, tuple(r.channels)) for r in got.collect()} == {(r.x, r.y, tuple(r.channels)) for r in p.collect()}


def test_node_states(spark):
    spec = ChunkSpec((16, 16, 16), {"v": 0}, 2)
    none = spark.createDataFrame([], "lod int, cx long, cy long, cz long, state long")
    marked = clipmap.mark_for_loading(none, spark.createDataFrame([(1, 0, 0, 0)], "lod int, cx long, cy long, cz long"), spec)
    assert as_set(marked, "lod", "cx", "state") == {(1, 0, 1), (2, 0, 1)}
    inherited = clipmap.inherited_state(spark.createDataFrame([(0, 16, 0, 0), (0, 64, 0, 0)], "lod int, cx long, cy long, cz long"), marked, spec)
    # the root of (64, 0, 0) is another one, which nothing was marked in
    assert as_set(inherited, "cx", "state") == {(16, 1), (64, None)}
    done = marked.withColumn("state", clipmap.set_bit(F.col("state"), clipmap.LOADING, False))
    assert done.agg(F.sum("state")).first()[0] == 0


def test_observers_stream(spark, tmp_path):
    spec = ChunkSpec((8, 8, 8))
    rows = [(1, 1, 0.0), (1, 2, 4.0), (2, 1, 100.0)]
    df = spark.createDataFrame(rows, "id long, t long, x double").select("id", F.timestamp_seconds("t").alias("ts"), "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = observers.entered(stream, spec, 6.0).writeStream.format("memory").queryName("entered").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select id, cx, cy, cz from entered").collect()}
    first, second = observers.slots_of((0.0, 0.0, 0.0), 6.0, spec), observers.slots_of((4.0, 0.0, 0.0), 6.0, spec)
    assert {g[1:] for g in got if g[0] == 1} == first | (second - first)
    batch = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 6.0)], "id long, x double, y double, z double, r double")
    assert as_set(clipmap.sphere_slots(batch, spec, 0), "cx", "cy", "cz") == first


def test_box_columns(spark):
    df = spark.createDataFrame([(0, 0, 0, 4, 4, 4), (1, 0, 0, 2, 2, 2), (0, 0, 0, 3, 2, 2)], "x long, y long, z long, sx long, sy long, sz long")
    box = X.Box(Vec.of(*AXES), Vec.of("sx", "sy", "sz"))
    assert [r[0] for r in df.select(box.orthant()).collect()] == ["ok", "Misaligned", "ShapeNotPow2"]
    low = X.float_box(Vec(F.lit(-0.5), F.lit(0.2)), Vec(F.lit(1.0), F.lit(1.0)))
    assert tuple(df.select(*low.minimum.parts, *low.shape.parts).first()) == (-1, 0, 2, 2)
    assert [tuple(r) for r in df.limit(1).select(Vec(F.lit(1), F.lit(0)).over(Vec(F.lit(0), F.lit(0)))[0]).collect()] == [(float("inf"),)]
    assert len(P.MOORE_3) == 26 and len(P.EDGES_3) == 12 and len(P.EDGES_2) == 4


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    theirs = con.sql(catalog.oracle_sql()[name])
    ours = catalog.queries()[name](spark, sf)
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)

    def plain(v):
        return round(float(v), 6) + 0.0 if isinstance(v, float) else v

    mine = sorted((tuple(plain(v) for v in r) for r in ours.select(*names).collect()), key=repr)
    want = sorted((tuple(plain(v) for v in r) for r in theirs.select(*(f'"{n}"' for n in names)).fetchall()), key=repr)
    assert mine == want


def test_pipelines(spark, tmp_path):
    from latticework.plans import pipelines

    spec = ChunkSpec((8, 8, 8), {"v": 1.0}, 1)
    table = pipelines.sample_and_store(spark, f"file://{tmp_path}/t", spec, Extent.cube((-8, -8, -8), 16), lambda p: (p.norm_squared() - 10).cast("double"), 1)
    assert table.read().where("lod = 0").count() == 8 and table.read().where("lod = 1").count() == 8
    vertices, triangles = pipelines.mesh_extent(table, Extent.cube((-6, -6, -6), 12))
    assert vertices.count() > 0 and triangles.count() == 2 * (vertices.count() - 2)
    assert pipelines.range_read(table, 0, Extent.cube((-8, -8, -8), 8)).count() == 1
    assert pipelines.orthant_read(table, 0, Orthant((0, 0, 0), 3)).count() == 1
    look = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    now, changes = pipelines.level_of_detail_step(table.read(), None, look, spec, 3.0)
    assert now.count() == changes.where("change = 'Spawn'").count() > 0


def test_rays_that_stand_still(spark):
    solid = points(spark, [(0, 0, 0), (5, 0, 0)])
    rays = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 9.0), (2, 3.5, 0.5, 0.5, 0.0, 0.0, 0.0, 9.0)], "ray_id long, sx double, sy double, sz double, vx double, vy double, vz double, max_toi double")
    assert as_set(search.cast_rays(rays, solid), "ray_id", "x", "toi") == {(1, 0, 0.0)}
    assert as_set(search.cast_balls(rays, solid, 0.25), "ray_id", "x", "toi") == {(1, 0, 0.0)}


@pytest.mark.parametrize("cast", [search.cast_rays, lambda r, v: search.cast_balls(r, v, 0.25)])
def test_casts_broadcast_no_rays_and_take_equal_ones_once(spark, cast):
    d = lambda v: v.cast("double")
    i = F.col("id")
    # 1000 rays of two kinds; ids 998 and 999 come twice, as either kind
    rays = spark.range(1000).select(F.least(i, i % 2 + 998).alias("ray_id"), d(i % 2 * 4 + 0.5).alias("sx"), F.lit(0.5).alias("sy"), F.lit(-3.0).alias("sz"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(1.0).alias("vz"), F.lit(30.0).alias("max_toi"))
    rays = rays.unionByName(rays.where("ray_id >= 998").withColumn("sx", 5 - F.col("sx")))
    solid = spark.range(2).select((F.col("id") * 4).alias("x"), F.lit(0).cast("long").alias("y"), (F.col("id") * 2).alias("z"))
    got = cast(rays, solid)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    first = {r.ray_id: (r.x, r.y, r.z) for r in got.collect()}
    assert first == {k: (0, 0, 0) if k % 2 == 0 or k >= 998 else (4, 0, 2) for k in range(1000)}
    path = search._on_path(rays, solid, ChunkSpec((16, 16, 16)), 0.0)
    assert path.count() == 4


def test_components_far_apart(spark):
    got = search.connected(points(spark, [(1 << 20, 0, 0), (-(1 << 20), 1, 0)]))
    assert got.select("component").distinct().count() == 2


def test_loading_slots_of_coarse_levels(spark):
    spec = ChunkSpec((16, 16, 16), root_lod=2)
    rows = [(0, 0, 0, 0, 1), (0, 16, 0, 0, 1), (0, 32, 0, 0, 0), (1, 0, 0, 0, 1), (1, 16, 0, 0, 1), (2, 0, 0, 0, 1)]
    nodes = spark.createDataFrame(rows, "lod int, cx long, cy long, cz long, state long")
    seen = spark.createDataFrame([(7, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    # the budget cuts level 0 alone; coarse chunks wait for the pending ones below them
    assert as_set(clipmap.loading_slots(nodes, seen, spec, 1), "lod", "cx") == {(0, 0), (1, 16)}
    assert as_set(clipmap.loading_slots(nodes, seen, spec, 1, top_down=True), "lod", "cx") == {(0, 0), (1, 0), (1, 16), (2, 0)}
