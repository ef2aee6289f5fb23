"""Named queries over the driver tables, each with DuckDB SQL of the same rows where it has any."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import extents as X
from latticework.functions import fields, morton
from latticework.functions import points as P
from latticework.functions.points import Vec
from latticework.model import AXES, ChunkSpec, Extent, Orthant
from latticework.operators import clipmap, maps, mesh, neighbours, octree, pyramid, search
from latticework.operators.plumbing import shared_folder
from latticework.sources import chunk_table, scan
from latticework.sources.tables import SDF, heights, part_points, sdf_chunks, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"with {_BASE} {sql}"
        return f

    return register


_BASE = """chunks as (select vec_id, 4*(vec_id % 8) as cx, 4*((vec_id // 8) % 8) as cy, 4*(vec_id // 64) as cz, embedding, label::bigint as label from embeddings),
sdf as (select cx + (i % 4) as x, cy + ((i // 4) % 4) as y, cz + (i // 16) as z, v, label, cx, cy, cz from (
  select cx, cy, cz, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from chunks)),
pts as (select l_partkey % 64 as x, l_suppkey % 64 as y, cast(trunc(l_quantity) as bigint) as z from lineitem),
heights as (select user_id % 32 as x, cast(extract(day from ts) as bigint) as y, round(avg(value), 6) as h from events group by all),
axis3(d, dx, dy, dz) as (values (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)),
boxes as (select o_orderkey as id, o_custkey % 40 - 5 as x, o_orderkey % 30 - 3 as y, cast(trunc(o_totalprice) as bigint) % 25 as z,
  1 + o_orderkey % 7 as sx, o_custkey % 6 as sy, 1 + o_orderkey % 4 as sz from orders)
"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("id"), (c % 40 - 5).alias("x"), (k % 30 - 3).alias("y"), (F.col("o_totalprice").cast("long") % 25).alias("z"), (1 + k % 7).alias("sx"), (c % 6).alias("sy"), (1 + k % 4).alias("sz"))


def box_of(prefix: str = "") -> X.Box:
    return X.Box(Vec.of(*[prefix + a for a in AXES]), Vec.of(*[prefix + "s" + a for a in AXES]))


def sdf_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the stored chunks, with labels."""
    spec = ChunkSpec(SDF.shape, {"v": 1.0}, SDF.root_lod)
    return maps.to_points(sdf_chunks(spark, sf).drop("lod"), spec)


def solids(spark: SparkSession, sf: str) -> DataFrame:
    return sdf_points(spark, sf).where("v < 0").select(*AXES)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    # adding 0 turns -0.0 into 0.0
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


SCAN = Extent((-2, 1, 3), (4, 3, 2))
BOX = Extent((2, 3, 1), (20, 17, 11))
IN_BOX = "x between 2 and 21 and y between 3 and 19 and z between 1 and 11"
GRID = "(select unnest(range(2, 22)) as x) cross join (select unnest(range(3, 20)) as y) cross join (select unnest(range(1, 12)) as z)"


# sources
@query("select x, y, z from (select unnest(range(-2, 2)) as x) cross join (select unnest(range(1, 4)) as y) cross join (select unnest(range(3, 5)) as z)")
def a2_iter_points(spark, sf):
    return scan.scan(spark, SCAN)


@query("select x, y, z, x*x + 2*y - z as v from (select unnest(range(-2, 2)) as x) cross join (select unnest(range(1, 4)) as y) cross join (select unnest(range(3, 5)) as z)")
def a1_a4_function_source(spark, sf):
    return scan.func(spark, SCAN, v=lambda p: p[0] * p[0] + p[1] * 2 - p[2])


@query("select x, y, z, 7 as v, 'a' as w from (select unnest(range(-2, 2)) as x) cross join (select unnest(range(1, 4)) as y) cross join (select unnest(range(3, 5)) as z)")
def a3_fill(spark, sf):
    return scan.fill(spark, SCAN, v=7, w="a")


@query("select vec_id, i % 4 as x, (i // 4) % 4 as y, i // 16 as z, round(v, 6) as v from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)")
def a5_flat_buffers(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    return rounded(scan.from_arrays(e, Extent((0, 0, 0), (4, 4, 4))), "v")


STORED = ChunkSpec(SDF.shape, {"label": 0}, SDF.root_lod)


def stored(spark, sf) -> chunk_table.ChunkTable:
    """The chunks' labels as a table on disk, sorted by Morton key."""
    path = f"{shared_folder(spark)}/lattice/{uuid.uuid4().hex}"
    out = chunk_table.ChunkTable(spark, path, STORED)
    out.create(sdf_chunks(spark, sf).select("lod", "cx", "cy", "cz", "label"))
    return out


@query("select cx, cy, cz, label from chunks where cx < 16 and cy < 16 and cz < 16")
def a10_orthant_scan(spark, sf):
    return stored(spark, sf).read(where=chunk_table.in_orthants(F.col("morton"), 0, [Orthant((0, 0, 0), 4)])).select("cx", "cy", "cz", "label")


@query("select cx, cy, cz, label from chunks where cx < 16 and cy < 16 and cz < 16")
def a11_covering_scan(spark, sf):
    return stored(spark, sf).read(where=chunk_table.in_orthants(F.col("morton"), 0, Orthant.covering(Extent((3, 3, 3), (10, 6, 6)), 3))).select("cx", "cy", "cz", "label")


@query("select cx, cy, cz, label from chunks where cx between 3 and 12 and cy between 3 and 8 and cz between 3 and 8")
def a11_covering_scan_exact(spark, sf):
    box = Extent((3, 3, 3), (10, 6, 6))
    return stored(spark, sf).read(where=chunk_table.in_orthants(F.col("morton"), 0, Orthant.covering(box, 3)) & maps.in_extent(box, maps.keys(SDF))).select("cx", "cy", "cz", "label")


@query("select cx, cy, cz, label from chunks")
def a12_level_scan(spark, sf):
    return stored(spark, sf).read(where=F.col("lod") == 0).select("cx", "cy", "cz", "label")


def _key_sql(names, lod=None) -> str:
    n = len(names)
    terms = " + ".join(f"((({c} + 2147483648) >> {i}) & 1)::hugeint * {1 << (n * i + a)}::hugeint" for i in range(32) for a, c in enumerate(names))
    return f"({terms})"


@query(f"select cx, cy, cz, label from (select *, {_key_sql(('cx', 'cy', 'cz'))} as k from chunks) where k >= {morton.key_of((4, 0, 0))}::hugeint and k < {morton.key_of((16, 16, 8))}::hugeint")
def a13_morton_range(spark, sf):
    return stored(spark, sf).read(where=chunk_table.in_range(F.col("morton"), 0, morton.key_of((4, 0, 0)), morton.key_of((16, 16, 8)), high_open=True)).select("cx", "cy", "cz", "label")


@query("select v, count(*) as n from (select case when sqrt(x*x + y*y + z*z) < 15 then 1 else 0 end as v from (select unnest(range(-16, 16)) as x) cross join (select unnest(range(-16, 16)) as y) cross join (select unnest(range(-16, 16)) as z)) group by v")
def a17_solid_sphere(spark, sf):
    return scan.solid_sphere(spark, 32).groupBy("v").agg(F.count("*").alias("n"))


def _noise_sql() -> str:
    """Six octaves of noise at x, y, z, a select an octave."""
    def hashed(i: int) -> str:
        prime = (1 << 31) - 1
        h = " + ".join(f"(c{a} + {i >> k & 1}) * {m}" for k, (a, m) in enumerate(zip(AXES, fields.NOISE_FACTORS))) + " + s * 40503"
        h = f"((({h}) % {prime}) + {prime}) % {prime}"
        for _ in range(2):
            h = f"(({h}) * ({h}) + ({h}) * 48271 + 11) % {prime}" if _ == 0 else f"(h{i} * h{i} + h{i} * 48271 + 11) % {prime}"
            if _ == 0:
                first = h
        return first, f"(({h}) % 1000003) / 500001.0::double - 1.0"
    firsts = ", ".join(f"{hashed(i)[0]} as h{i}" for i in range(8))
    v = [hashed(i)[1] for i in range(8)]
    names = ", ".join(f"{x} as v{i}" for i, x in enumerate(v))
    lin = [f"v{i}" for i in range(8)]
    for a in AXES:
        lin = [f"({lin[i]} * (1 - t{a}) + {lin[i + 1]} * t{a})" for i in range(0, len(lin), 2)]
    points = "(select unnest(range(-4, 12)) as x) cross join (select unnest(range(-4, 12)) as y) cross join (select unnest(range(0, 2)) as z)"
    q = ", ".join(f"{a} * 0.25::double * (1 << o) - floor({a} * 0.25::double * (1 << o)) as t{a}, floor({a} * 0.25::double * (1 << o))::bigint as c{a}" for a in AXES)
    return f"""select x, y, z, round(sum({lin[0]} / (1 << o)) / {sum(0.5**o for o in range(6))}, 6) + 0.0 as v from (select *, {names} from (select *, {firsts} from (
      select x, y, z, o, 1010 + o as s, {q} from {points} cross join (select unnest(range(6)) as o)))) group by x, y, z"""


@query(_noise_sql())
def a16_noise(spark, sf):
    return rounded(scan.noise(spark, Extent((-4, -4, 0), (16, 16, 2)), 0.25, 1010, 6), "v")


# keys
@query(f"select distinct x, y, z, cast({_key_sql(('x', 'y', 'z'))} as varchar) as key from pts")
def i2_morton_3d(spark, sf):
    return part_points(spark, sf).distinct().withColumn("key", morton.morton(Vec.of(*AXES)).cast("string"))


@query(f"select distinct x, y, cast({_key_sql(('x', 'y'))} as varchar) as key from pts")
def i2_morton_2d(spark, sf):
    return part_points(spark, sf).select("x", "y").distinct().withColumn("key", morton.morton(Vec.of("x", "y")).cast("string"))


@query("select distinct -x as x, y - 70 as y, z from pts")
def i2_morton_round_trip(spark, sf):
    p = part_points(spark, sf).distinct().select((-F.col("x")).alias("x"), (F.col("y") - 70).alias("y"), "z")
    keyed = p.select(morton.morton(Vec.of(*AXES)).alias("k"))
    return keyed.select(*morton.demorton(*morton.split(F.col("k"))).named(*AXES))


@query(f"select distinct x, y, z, '03' || lpad(upper(printf('%x', cast(({_key_sql(('x', 'y', 'z'))}) // 281474976710656 as bigint))), 12, '0') || lpad(upper(printf('%x', cast(({_key_sql(('x', 'y', 'z'))}) % 281474976710656 as bigint))), 12, '0') as key from pts")
def b7_ordered_key_bytes(spark, sf):
    return part_points(spark, sf).distinct().withColumn("key", F.hex(morton.ord_key(F.lit(3), Vec.of(*AXES))))


# changes
@query("select cx, cy, cz, round(case when label = 5 then -embedding[1] else embedding[1] end, 6) as first from chunks where label <> 3")
def b1_apply_changes(spark, sf):
    c = sdf_chunks(spark, sf)
    base = c.select("lod", "cx", "cy", "cz", "v")
    up = c.where("label = 5").select("lod", "cx", "cy", "cz", F.transform("v", lambda x: -x).alias("v"))
    changes = chunk_table.deltas(up, SDF, c.where("label = 3"))
    return rounded(chunk_table.apply(base, changes, SDF).select("cx", "cy", "cz", F.get("v", F.lit(0)).alias("first")), "first")


@query("select cx, cy, cz, round(case when label in (2, 4) then 2.0 else embedding[1] end, 6) as first from chunks where label <> 1")
def b4_later_change_wins(spark, sf):
    c = sdf_chunks(spark, sf)
    base, on = c.select("lod", "cx", "cy", "cz", "v"), ("lod", "cx", "cy", "cz")
    one = chunk_table.deltas(c.where("label in (1, 2)").select(*on, maps.ambient_array(3.0, SDF).alias("v")), SDF, c.where("label = 4")).withColumn("n", F.lit(1))
    two = chunk_table.deltas(c.where("label in (2, 4)").select(*on, maps.ambient_array(2.0, SDF).alias("v")), SDF, c.where("label = 1")).withColumn("n", F.lit(2))
    return rounded(chunk_table.apply(base, one.unionByName(two), SDF, "n").select("cx", "cy", "cz", F.get("v", F.lit(0)).alias("first")), "first")


# access
@query("select p.x, p.y, p.z, round(coalesce(s.v, 1.0), 6) as v from (select distinct x % 40 as x, y % 32 as y, z % 36 as z from pts) p left join sdf s using (x, y, z)")
def c10_get_points(spark, sf):
    p = part_points(spark, sf).select((F.col("x") % 40).alias("x"), (F.col("y") % 32).alias("y"), (F.col("z") % 36).alias("z")).distinct()
    return rounded(maps.get_points(p, sdf_chunks(spark, sf), SDF), "v")


@query("""select cx, cy, cz, count(*) filter (where v = 9) as written, count(*) filter (where v = 1) as vacant, count(*) as n from (
  select x - x % 4 as cx, y - y % 4 as cy, z - z % 4 as cz, v from (
    select g.cx + (i % 4) as x, g.cy + ((i // 4) % 4) as y, g.cz + (i // 16) as z, case when w.x is not null then 9.0 else coalesce(s.v, 1.0) end as v
    from (select cx, cy, cz from chunks union select x - x % 4, y - y % 4, z - z % 4 from pts) g cross join (select unnest(range(64)) as i)
    left join (select distinct x, y, z from pts) w on w.x = g.cx + (i % 4) and w.y = g.cy + ((i // 4) % 4) and w.z = g.cz + (i // 16)
    left join sdf s on s.x = g.cx + (i % 4) and s.y = g.cy + ((i // 4) % 4) and s.z = g.cz + (i // 16))) group by all""")
def c11_set_points(spark, sf):
    writes = part_points(spark, sf).distinct().withColumn("v", F.lit(9.0))
    done = maps.set_points(sdf_chunks(spark, sf).drop("label"), writes, SDF)
    count = lambda w: F.size(F.filter("v", lambda x: x == w)).cast("long")
    return done.select("cx", "cy", "cz", count(9.0).alias("written"), count(1.0).alias("vacant"), F.size("v").cast("long").alias("n"))


@query(f"select x, y, z, round(v, 6) as v from sdf where {IN_BOX}")
def c8_c13_extent_filter(spark, sf):
    return rounded(maps.to_points(sdf_chunks(spark, sf).select("cx", "cy", "cz", "v"), SDF, BOX), "v")


@query("select x + 5 as x, y - 2 as y, z + 1 as z, count(*) as n from pts group by all")
def c14_translate(spark, sf):
    return maps.translate(part_points(spark, sf).groupBy(*AXES).agg(F.count("*").alias("n")), (5, -2, 1))


@query("select x, y, z, (z * 64 + y) * 64 + x as i, x as bx, y as by_, z as bz from (select distinct x, y, z from pts)")
def c16_strides(spark, sf):
    p = part_points(spark, sf).distinct().withColumn("i", P.stride(Vec.of(*AXES), (64, 64, 64)))
    return p.withColumns(dict(zip(("bx", "by_", "bz"), P.from_stride(F.col("i"), (64, 64, 64)).parts)))


@query("select c.cx, c.cy, c.cz, n.n_name as name, r.r_name as region from chunks c left join nation n on n.n_nationkey = c.label left join region r on r.r_regionkey = n.n_regionkey")
def c6_f7_palette(spark, sf):
    c = sdf_chunks(spark, sf).select("cx", "cy", "cz", "label")
    colours = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return maps.palette(c, colours, "label", "n_nationkey").drop("label")


@query(f"select x, y, z, round(coalesce(2 * v + 1, 3.0), 6) as v from {GRID} left join sdf using (x, y, z)")
def c6_transform_with_ambient(spark, sf):
    changed, spec = maps.transform(sdf_chunks(spark, sf).drop("label"), SDF, v=lambda c: c * 2 + 1)
    return rounded(maps.read_extent(changed, spec, BOX), "v")


# bulk
@query(f"select x, y, z, round(coalesce(v, 1.0), 6) as v from {GRID} left join sdf using (x, y, z)")
def d7_d14_read_extent(spark, sf):
    return rounded(maps.read_extent(sdf_chunks(spark, sf), SDF, BOX), "v")


@query(f"select x, y, z, round(coalesce(v, 1.0), 6) as v from {GRID} left join sdf using (x, y, z)")
def d1_copy_extent(spark, sf):
    target = ChunkSpec((8, 8, 8), {"v": -5.0})
    empty = maps.to_chunks(scan.func(spark, Extent((0, 0, 0), (0, 0, 0)), v=lambda p: F.lit(0.0)), target)
    done = maps.copy_extent(sdf_chunks(spark, sf), SDF, empty, target, BOX)
    return rounded(maps.read_extent(done, target, BOX), "v")


@query(f"select x, y, z, round(case when {IN_BOX} then 0.5 else v end, 6) as v from sdf")
def d9_fill_extent(spark, sf):
    done = maps.fill_extent(sdf_chunks(spark, sf), SDF, BOX, v=0.5)
    stored = done.join(sdf_chunks(spark, sf).select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_semi")
    return rounded(maps.to_points(stored.drop("lod"), SDF), "v")


@query(f"select x, y, z, round(case when {IN_BOX} then x + 0.5*y - z else v end, 6) as v from sdf")
def d6_write_function(spark, sf):
    done = maps.map_extent(sdf_chunks(spark, sf), SDF, BOX, v=lambda p: p[0] + p[1] * 0.5 - p[2])
    stored = done.join(sdf_chunks(spark, sf).select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_semi")
    return rounded(maps.to_points(stored.drop("lod"), SDF), "v")


@query("""select g.cx, g.cy, g.cz, c.cx is null as is_ambient from (select 4*x as cx, 4*y as cy, 4*z as cz from (select unnest(range(0, 9)) as x) cross join (select unnest(range(5, 9)) as y) cross join (select unnest(range(6, 9)) as z)) g
  left join chunks c on c.cx = g.cx and c.cy = g.cy and c.cz = g.cz""")
def d12_visit_chunks(spark, sf):
    return maps.visit_chunks(sdf_chunks(spark, sf), SDF, Extent((1, 21, 25), (34, 14, 10))).select("cx", "cy", "cz", "is_ambient")


@query("select cx, cy, cz, 64 as n, 64 * 0.25 as total from chunks")
def d10_reset_values(spark, sf):
    done = maps.reset_values(sdf_chunks(spark, sf), SDF, v=0.25)
    return done.select("cx", "cy", "cz", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("select a.x, a.y, a.z, round(a.v, 6) as v, round(b.v, 6) as other from sdf a join sdf b on b.x = a.x + 3 and b.y = a.y - 1 and b.z = a.z")
def d16_f4_lock_step(spark, sf):
    s = sdf_points(spark, sf).drop("label")
    return rounded(maps.lock_step(s, s, (3, -1, 0)), "v", "other")


@query("select (x - 1) // 3 as x, y // 2 as y, (z - 2) // 4 as z, round(v, 6) as v from sdf where x >= 1 and z >= 2 and (x - 1) % 3 = 0 and y % 2 = 0 and (z - 2) % 4 = 0")
def d18_strided_scan(spark, sf):
    return rounded(maps.strided(sdf_points(spark, sf).drop("label"), (1, 0, 2), (3, 2, 4)), "v")


# boxes
@query("""select id, greatest(x, 4) as mx, greatest(y, 2) as my, greatest(z, 3) as mz,
  greatest(0, least(x + sx, 20) - greatest(x, 4)) as nx, greatest(0, least(y + sy, 18) - greatest(y, 2)) as ny, greatest(0, least(z + sz, 16) - greatest(z, 3)) as nz from boxes""")
def e4_intersection(spark, sf):
    other = X.Box(Vec(4, 2, 3), Vec(16, 16, 13))
    i = box_of().intersection(other)
    return boxes(spark, sf).select("id", *i.minimum.named("mx", "my", "mz"), *i.shape.named("nx", "ny", "nz"))


@query("select id, least(x, 4) as mx, least(y, 2) as my, least(z, 3) as mz, greatest(x + sx, 20) as lx, greatest(y + sy, 18) as ly, greatest(z + sz, 16) as lz from boxes")
def e5_quasi_union(spark, sf):
    u = box_of().quasi_union(X.Box(Vec(4, 2, 3), Vec(16, 16, 13)))
    return boxes(spark, sf).select("id", *u.minimum.named("mx", "my", "mz"), *u.lub.named("lx", "ly", "lz"))


@query("""select id, sx*sy*sz as volume, sx*sy*sz = 0 as empty, x + sx as lx, z + sz - 1 as tz, (sx + 4)*(sy + 4)*(sz + 4) as padded,
  greatest(x, 0) = x and greatest(y, 0) = y and greatest(z, 0) = z and greatest(0, least(x + sx, 30) - greatest(x, 0)) = sx and greatest(0, least(y + sy, 30) - greatest(y, 0)) = sy and greatest(0, least(z + sz, 30) - greatest(z, 0)) = sz as inside,
  sx - 3 > 0 or sy - 3 > 0 or sz - 3 > 0 as positive, x * 2 as dx, x >> 1 as hx, sx << 2 as qx from boxes""")
def e_box_measures(spark, sf):
    b = box_of()
    return boxes(spark, sf).select(
        "id", b.volume().alias("volume"), b.is_empty().alias("empty"), b.lub[0].alias("lx"), b.maximum[2].alias("tz"), b.padded(2).volume().alias("padded"), b.is_subset_of(X.Box(Vec(0, 0, 0), Vec(30, 30, 30))).alias("inside"),
        b.add_to_shape(-3).is_positive().alias("positive"), b.scaled(2).minimum[0].alias("dx"), (b >> 1).minimum[0].alias("hx"), (b << 2).shape[0].alias("qx"),
    )


@query("select min(x) as x0, min(y) as y0, min(z) as z0, max(x) + 1 as x1, max(y) + 1 as y1, max(z) + 1 as z1 from pts")
def e6_bounding_extent(spark, sf):
    return maps.bounding_extent(part_points(spark, sf))


@query("select id, i as k, case when i & 1 = 1 then x + sx else x end as cx, case when i & 2 = 2 then y + sy else y end as cy, case when i & 4 = 4 then z + sz else z end as cz from boxes cross join (select unnest(range(8))::integer as i)")
def e10_corners(spark, sf):
    c = boxes(spark, sf).select("id", F.posexplode(box_of().corners()).alias("k", "c"))
    return c.select("id", "k", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))


@query("""select id, case when sx not in (1, 2, 4, 8) or sy not in (1, 2, 4, 8) or sz not in (1, 2, 4, 8) then 'ShapeNotPow2' when sx <> sy or sy <> sz then 'ShapeNotCube'
  when x % sx <> 0 or y % sx <> 0 or z % sx <> 0 then 'Misaligned' else 'ok' end as kind from boxes""")
def e14_orthant_of_extent(spark, sf):
    return boxes(spark, sf).select("id", box_of().orthant().alias("kind"))


@query("""select id, ox * 4 as ox, oy * 4 as oy, oz * 4 as oz from (select id, unnest(range(x >> 2, ((x + sx - 1) >> 2) + 1)) as ox, y, z, sy, sz from boxes where sy > 0) a
  , lateral (select unnest(range(y >> 2, ((y + sy - 1) >> 2) + 1)) as oy) b, lateral (select unnest(range(z >> 2, ((z + sz - 1) >> 2) + 1)) as oz) c""")
def e15_covering_orthants(spark, sf):
    b = boxes(spark, sf).withColumns(dict(zip(("x1", "y1", "z1"), box_of().lub.parts)))
    return X.covering_orthants(b, 2).select("id", "ox", "oy", "oz")


@query("select id, sqrt((x-10)**2 + (y-10)**2 + (z-10)**2) + 1 < 8 as inside, sqrt((x-10)**2 + (y-10)**2 + (z-10)**2) < 9 as touches from boxes")
def e16_spheres(spark, sf):
    c, o = Vec.of(*AXES), Vec(10, 10, 10)
    return boxes(spark, sf).select("id", X.sphere_contains(o, F.lit(8), c, F.lit(1)).alias("inside"), X.spheres_intersect(o, F.lit(8), c, F.lit(1)).alias("touches"))


# joins
@query("select b.id, count(*) as n from boxes b join pts p on p.x >= b.x and p.x < b.x + b.sx and p.y >= b.y and p.y < b.y + b.sy and p.z >= b.z and p.z < b.z + b.sz group by b.id")
def f1_points_in_boxes(spark, sf):
    b = boxes(spark, sf).select("id", *[F.col(a).alias(f"{a}0") for a in AXES], *box_of().lub.named("x1", "y1", "z1"))
    return neighbours.count_in_boxes(part_points(spark, sf), b, ChunkSpec((4, 4, 4)))


@query(f"select distinct a.x, a.y, a.z from sdf a cross join axis3 d left join sdf b on b.x = a.x + d.dx and b.y = a.y + d.dy and b.z = a.z + d.dz and b.v < 0 where a.v < 0 and b.x is null and a.{IN_BOX.replace(' and ', ' and a.').replace('between 2 and a.21', 'between 2 and 21').replace('between 3 and a.19', 'between 3 and 19').replace('between 1 and a.11', 'between 1 and 11')}")
def f5_l7_surface_points(spark, sf):
    return neighbours.surface_points(solids(spark, sf), BOX)


@query("""select a.x, a.y, a.z, ['x', 'y', 'z'][d.d // 2 + 1] as axis, case when d.d % 2 = 0 then -1 else 1 end as sign from (select x, y, z, label % 2 = 0 as o from sdf where v < 0) a cross join axis3 d
  left join (select x, y, z, label % 2 = 0 as o from sdf where v < 0) b on b.x = a.x + d.dx and b.y = a.y + d.dy and b.z = a.z + d.dz where b.x is null or (a.o and not b.o)""")
def f6_visible_faces(spark, sf):
    e = sdf_chunks(spark, sf).select("cx", "cy", "cz", "label")
    s = maps.with_keys(solids(spark, sf), SDF).join(e, ["cx", "cy", "cz"]).select(*AXES, (F.col("label") % 2 == 0).alias("opaque"))
    return neighbours.visible_faces(s)


@query("select a.cx, a.cy, a.cz, count(*) as n from chunks a join chunks b on abs(a.cx - b.cx) <= 4 and abs(a.cy - b.cy) <= 4 and abs(a.cz - b.cz) <= 4 and a.vec_id <> b.vec_id group by all")
def f8_moore_neighbour_chunks(spark, sf):
    return neighbours.chunk_neighbours(sdf_chunks(spark, sf), SDF).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))


@query("select s.s_suppkey as id, count(*) as n from supplier s join chunks c on sqrt((s_suppkey % 32 - c.cx - 2)**2 + (s_nationkey - c.cy - 2)**2 + (s_suppkey % 7 - c.cz - 2)**2) < 5 + 2*sqrt(3.0::double) group by 1")
def f9_spheres_on_chunks(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 32).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 7).cast("double").alias("z"), F.lit(5.0).alias("r"))
    return neighbours.spheres_on_chunks(s, sdf_chunks(spark, sf).select("cx", "cy", "cz"), SDF).groupBy("id").agg(F.count("*").alias("n"))


# levels
@query("select x // 2 as x, y // 2 as y, z // 2 as z, round(v, 6) as v from sdf where x % 2 = 0 and y % 2 = 0 and z % 2 = 0")
def g2_point_sampler(spark, sf):
    return rounded(pyramid.sample_points(sdf_points(spark, sf).drop("label")), "v")


@query("select x // 2 as x, y // 2 as y, z // 2 as z, round(sum(v) / 16, 6) as v from sdf group by all")
def g3_mean_sampler(spark, sf):
    return rounded(pyramid.sample_mean(sdf_points(spark, sf), ["v"]), "v")


@query("select x // 2 as x, y // 2 as y, z // 2 as z, cast(trunc(sum(cast(trunc(127 * greatest(-1, least(1, v))) as tinyint))::double / 16) as tinyint) as v from sdf group by all")
def g3_mean_sampler_quantised(spark, sf):
    q = sdf_points(spark, sf).withColumn("v", fields.quantise(F.col("v")))
    return pyramid.sample_mean(q, ["v"], bits=8)


@query("""select lod, round(sum(v), 4) as total, count(*) as n, count(distinct (cx, cy, cz)) as chunks from (
  select 0 as lod, x, y, z, v, cx, cy, cz from sdf
  union all select 1, x, y, z, v, x - x % 4, y - y % 4, z - z % 4 from l1
  union all select 2, x, y, z, v, x - x % 4, y - y % 4, z - z % 4 from l2) group by lod""")
def g4_mip_chain(spark, sf):
    chain = pyramid.mip_chain(sdf_chunks(spark, sf), SDF, 2)
    one = chain.select("lod", F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("t"), F.size("v").alias("s"))
    return rounded(one.groupBy("lod").agg(F.sum("t").alias("total"), F.sum("s").alias("n"), F.count("*").alias("chunks")), "total", digits=4)


# a coarse level is dense inside its chunks: vacant parts are ambient
_SQL["g4_mip_chain"] = _SQL["g4_mip_chain"].replace("select lod, round(sum(v), 4)", """, k1 as (select distinct ((cx >> 3) << 2) as cx, ((cy >> 3) << 2) as cy, ((cz >> 3) << 2) as cz from chunks),
l1 as (select k.cx + (i % 4) as x, k.cy + ((i // 4) % 4) as y, k.cz + (i // 16) as z, coalesce(s.v, 1.0) as v from k1 k cross join (select unnest(range(64)) as i)
  left join (select x // 2 as x, y // 2 as y, z // 2 as z, sum(v) / 16 as v from sdf group by all) s on s.x = k.cx + (i % 4) and s.y = k.cy + ((i // 4) % 4) and s.z = k.cz + (i // 16)),
k2 as (select distinct ((cx >> 3) << 2) as cx, ((cy >> 3) << 2) as cy, ((cz >> 3) << 2) as cz from k1),
l2 as (select k.cx + (i % 4) as x, k.cy + ((i // 4) % 4) as y, k.cz + (i // 16) as z, coalesce(s.v, 1.0) as v from k2 k cross join (select unnest(range(64)) as i)
  left join (select x // 2 as x, y // 2 as y, z // 2 as z, sum(v) / 16 as v from l1 group by all) s on s.x = k.cx + (i % 4) and s.y = k.cy + ((i // 4) % 4) and s.z = k.cz + (i // 16))
select lod, round(sum(v), 4)""", 1)


@query("select cx, cy, cz, (cx // 8) * 4 as parent_cx, (cy // 8) * 4 as parent_cy, (cz // 8) * 4 as parent_cz, (cx // 4) % 2 * 2 as at_x, (cy // 4) % 2 * 2 as at_y, (cz // 4) % 2 * 2 as at_z from chunks")
def g9_downsample_destination(spark, sf):
    return pyramid.destination(sdf_chunks(spark, sf).select("cx", "cy", "cz"), SDF)


@query("select min(cx) as x0, min(cy) as y0, min(cz) as z0, max(cx) + 4 as x1, max(cy) + 4 as y1, max(cz) + 4 as z1 from chunks")
def g10_bounding_chunks(spark, sf):
    return maps.bounding_chunks(sdf_chunks(spark, sf), SDF)


def _levels_sql(n: int) -> str:
    out = ["n0 as (select 0 as level, x, y, z, 0::bigint as mask, true as is_full from (select distinct x, y, z from pts))"]
    for k in range(1, n + 1):
        e = 1 << k - 1
        out.append(
            f"n{k} as (select {k} as level, x // {2 * e} * {2 * e} as x, y // {2 * e} * {2 * e} as y, z // {2 * e} * {2 * e} as z, bit_or(1::bigint << cast((x // {e}) % 2 + 2 * ((y // {e}) % 2) + 4 * ((z // {e}) % 2) as integer)) as mask, sum(is_full::int) = 8 as is_full from n{k - 1} group by 2, 3, 4)"
        )
    return ", " + ", ".join(out) + ", nodes as (" + " union all ".join(f"select * from n{k}" for k in range(n + 1)) + ")"


@query(_levels_sql(6) + " select level, x, y, z, mask, is_full from nodes")
def g12_octree_roll_up(spark, sf):
    return octree.roll_up(part_points(spark, sf), 6)


@query(_levels_sql(6) + " select a.level, a.x, a.y, a.z, a.mask, a.is_full from nodes a where (a.level > 0 or a.is_full) and not exists (select 1 from nodes p where p.is_full and p.level = a.level + 1 and a.x >= p.x and a.x < p.x + (1 << p.level) and a.y >= p.y and a.y < p.y + (1 << p.level) and a.z >= p.z and a.z < p.z + (1 << p.level))")
def k7_branches_and_full_leaves(spark, sf):
    return octree.branches_and_leaves(octree.roll_up(part_points(spark, sf), 6), 6)


@query(_levels_sql(4) + " select level, x, y, z from nodes where x < 30 and x + (1 << level) > 9 and y < 20 and y + (1 << level) > 5 and z < 25 and z + (1 << level) > 10")
def k9_octants_on_extent(spark, sf):
    return octree.overlapping(octree.roll_up(part_points(spark, sf), 4), Extent((9, 5, 10), (21, 15, 15))).select("level", *AXES)


@query(_levels_sql(3) + " select x, y, z, 512 + 64 * (x // 4 % 2 + 2 * (y // 4 % 2) + 4 * (z // 4 % 2)) + 8 * (x // 2 % 2 + 2 * (y // 2 % 2) + 4 * (z // 2 % 2)) + (x % 2 + 2 * (y % 2) + 4 * (z % 2)) as code from n0")
def k13_location_codes(spark, sf):
    return octree.roll_up(part_points(spark, sf), 3).where("level = 0").select(*AXES, octree.location_code(3).alias("code"))


@query(_levels_sql(2) + " select n.level - 1 as level, n.x + (c & 1) * (1 << (n.level - 1)) as x, n.y + ((c >> 1) & 1) * (1 << (n.level - 1)) as y, n.z + ((c >> 2) & 1) * (1 << (n.level - 1)) as z, c::integer as corner from nodes n cross join (select unnest(range(8)) as c) where n.level > 0 and (n.mask >> cast(c as integer)) & 1 = 1")
def f10_k16_octree_children(spark, sf):
    return octree.children(octree.roll_up(part_points(spark, sf), 2))


@query("select s as level, 8 * (x // 8) + (1 << s) * i as x, 8 * (y // 8) + (1 << s) * j as y, 8 * (z // 8) + (1 << s) * k as z from (select distinct x // 8 * 8 as x, y // 8 * 8 as y, z // 8 * 8 as z from pts) cross join (select unnest(range(4))::integer as s), lateral (select unnest(range(8 >> s)) as i) a, lateral (select unnest(range(8 >> s)) as j) b, lateral (select unnest(range(8 >> s)) as k) c")
def k12_octant_descendants(spark, sf):
    eight = part_points(spark, sf).select(F.lit(3).alias("level"), *[(F.col(a) - F.col(a) % 8).alias(a) for a in AXES]).distinct()
    return octree.descendants(eight)


# sets
@query("select distinct x, y, z from (select x, y, z from pts union select x, y, z from (select unnest(range(60, 70)) as x) cross join (select unnest(range(5, 10)) as y) cross join (select unnest(range(0, 4)) as z))")
def j1_add_extent(spark, sf):
    return octree.add_extent(part_points(spark, sf).distinct(), Extent((60, 5, 0), (10, 5, 4)))


@query("select distinct x, y, z from pts where not (x between 10 and 39 and y between 0 and 49 and z between 5 and 24)")
def j2_subtract_extent(spark, sf):
    return octree.subtract_extent(part_points(spark, sf).distinct(), Extent((10, 0, 5), (30, 50, 20)))


@query("select x, y, z, x - x % 16 as cx, y - y % 16 as cy, z - z % 16 as cz, (z % 16 * 16 + y % 16) * 16 + x % 16 as idx from (select distinct x, y, z from pts)")
def k1_chunk_of_point(spark, sf):
    return maps.with_keys(part_points(spark, sf).distinct(), ChunkSpec((16, 16, 16)))


@query("select cx, cy, cz, (cx >> 4) * 4 as px, (cy >> 4) * 4 as py, (cz >> 4) * 4 as pz, ((cx >> 2) & 1) + 2 * ((cy >> 2) & 1) + 4 * ((cz >> 2) & 1) as corner from (select cx - 40 as cx, cy, cz from chunks where (cx - 40) % 8 = 0 union all select cx, cy, cz from chunks)")
def k2_k3_ancestors_and_corners(spark, sf):
    c = sdf_chunks(spark, sf).select("cx", "cy", "cz")
    c = c.withColumn("cx", F.col("cx") - 40).where("cx % 8 = 0").unionByName(c)
    p = Vec.of("cx", "cy", "cz")
    return c.select("cx", "cy", "cz", *pyramid.parent_key(p, SDF, 2).named("px", "py", "pz"), pyramid.corner_of(p, SDF).alias("corner"))


# stencils
@query("select a.x, a.y, a.z, round(sum(coalesce(b.v, 1.0)), 5) as around from sdf a cross join axis3 d left join sdf b on b.x = a.x + d.dx and b.y = a.y + d.dy and b.z = a.z + d.dz group by 1, 2, 3")
def h1_h8_neighbour_sums(spark, sf):
    return rounded(neighbours.neighbour_sum(sdf_points(spark, sf).select(*AXES, "v"), P.VON_NEUMANN_3, ambient=1.0).select(*AXES, "around"), "around", digits=5)


@query("select a.x, a.y, round(sum(coalesce(b.h, 0)), 6) as around from heights a cross join (select unnest(range(-1, 2)) as dx) cross join (select unnest(range(-1, 2)) as dy) left join heights b on b.x = a.x + dx and b.y = a.y + dy where not (dx = 0 and dy = 0) group by 1, 2")
def h2_moore_sums_2d(spark, sf):
    return rounded(neighbours.neighbour_sum(heights(spark, sf), P.MOORE_2, "h").select("x", "y", "around"), "around")


@query("select a.x, a.y from (select distinct x, y from heights where h > 0) a where a.x between 1 and 30 and a.y between 2 and 29 and exists (select 1 from (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) where not exists (select 1 from heights b where b.x = a.x + dx and b.y = a.y + dy and b.h > 0))")
def f5_surface_points_2d(spark, sf):
    return neighbours.surface_points(heights(spark, sf).where("h > 0").select("x", "y"), Extent((1, 2), (30, 28)))


@query("""select a.x, a.y, a.z, round(a.v, 6) as v0, round(coalesce(-b.v, 1.0), 6) as v1, round(coalesce(c.v + 1, 1.0), 6) as v2 from sdf a
  left join (select * from sdf where label <> 3) b using (x, y, z) left join (select * from sdf where label > 4) c using (x, y, z)""")
def c3_zip_three_maps(spark, sf):
    c = sdf_chunks(spark, sf)
    one, spec = c.select("cx", "cy", "cz", "v"), ChunkSpec(SDF.shape, {"v": 1.0}, SDF.root_lod)
    two = c.where("label <> 3").select("cx", "cy", "cz", F.transform("v", lambda x: -x).alias("v"))
    three = c.where("label > 4").select("cx", "cy", "cz", F.transform("v", lambda x: x + 1).alias("v"))
    return rounded(maps.zip_maps(spec, one, two, three), "v0", "v1", "v2")


@query("select x // 2 as x, y // 2 as y, z // 2 as z, round(max(v), 6) as v from sdf group by all")
def p9_own_sampler(spark, sf):
    spec = ChunkSpec(SDF.shape, {"v": 1.0}, SDF.root_lod)
    return rounded(pyramid.sampled(sdf_points(spark, sf).drop("label"), spec, F.array_max), "v")


@query("""select cx, cy, cz, round(sum(v), 4) as total from (select x - x % 4 as cx, y - y % 4 as cy, z - z % 4 as cz, v from
  (select x // 2 as x, y // 2 as y, z // 2 as z, sum(label + 0.5) / 16 as v from sdf where (cx >> 4) << 2 = 4 and (cy >> 4) << 2 = 0 and (cz >> 4) << 2 = 0 group by all)) group by all""")
def g5_g7_downsample_descendants(spark, sf):
    c = sdf_chunks(spark, sf)
    spec = ChunkSpec(SDF.shape, {"v": 0.0}, SDF.root_lod)
    other = c.select("lod", "cx", "cy", "cz", maps.ambient_array(F.col("label") + 0.5, spec).alias("v"))
    made = pyramid.downsample_under(c, spec, 2, (4, 0, 0), lod0=other, target=c.where("label < 0"))
    return rounded(made.where("lod = 1").select("cx", "cy", "cz", F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total")), "total", digits=4)


@query("select version, lod, count(*) as changes, count(*) filter (where op = 'i') as inserts, count(*) filter (where op = 'r') as removes from (select 0 as version, 0 as lod, 'i' as op from chunks union all select 1, 0, case when label = 2 then 'r' else 'i' end from chunks where label in (2, 3)) group by all")
def b12_g15_storage(spark, sf):
    t = stored(spark, sf)
    c = sdf_chunks(spark, sf).select("lod", "cx", "cy", "cz", "label")
    t.snapshot()
    t.commit(chunk_table.deltas(c.where("label = 3"), STORED, c.where("label = 2")))
    return t.storage()


@query("select cx, cy, cz, case when label = 3 then 100 else label end as label from chunks where label <> 2")
def b9_b14_versions(spark, sf):
    """The child of a snapshot; the changes of a sibling don't show."""
    t = stored(spark, sf)
    c = sdf_chunks(spark, sf).select("lod", "cx", "cy", "cz", "label")
    child = t.snapshot()
    t.commit(chunk_table.deltas(c.where("label = 3").withColumn("label", F.lit(100).cast("long")), STORED, c.where("label = 2")))
    t.set_current(0)
    t.snapshot()
    t.commit(chunk_table.deltas(c.where("label = 1").withColumn("label", F.lit(7).cast("long")), STORED))
    return t.read(child).select("cx", "cy", "cz", "label")


@query("""select cx, cy, cz, count(*) as n, round(sum(v), 5) as total from (select c.cx, c.cy, c.cz, s.v from chunks c join sdf s on s.x between c.cx - 1 and c.cx + 4 and s.y between c.cy - 1 and c.cy + 4 and s.z between c.cz - 1 and c.cz + 4) group by all""")
def h7_halo_exchange(spark, sf):
    padded = neighbours.halo(sdf_points(spark, sf), SDF)
    own = padded.join(sdf_chunks(spark, sf).select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_semi")
    return rounded(own.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", digits=5)


# search
RAYS = "rays as (select c_custkey as ray_id, (c_custkey % 31) + 0.5 as sx, (c_nationkey % 29) + 0.5 as sy, -3.0 as sz, (c_custkey % 5 - 2) * 0.25 as vx, (c_nationkey % 3 - 1) * 0.5 as vy, 1.0 as vz, 30.0 as max_toi from customer)"


def rays(spark, sf) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    d = lambda v: v.cast("double")
    return table(spark, sf, "customer").select(
        c.alias("ray_id"), d(c % 31 + 0.5).alias("sx"), d(n % 29 + 0.5).alias("sy"), F.lit(-3.0).alias("sz"), d((c % 5 - 2) * 0.25).alias("vx"), d((n % 3 - 1) * 0.5).alias("vy"), F.lit(1.0).alias("vz"), F.lit(30.0).alias("max_toi")
    )


def _slab(a: str, which: str) -> str:
    t0, t1 = f"(p.{a} - r.s{a}) / nullif(r.v{a}, 0)", f"(p.{a} + 1 - r.s{a}) / nullif(r.v{a}, 0)"
    inside = f"r.s{a} between p.{a} and p.{a} + 1"
    if which == "near":
        return f"case when r.v{a} <> 0 then least({t0}, {t1}) when {inside} then 0 else 1e300 end"
    return f"case when r.v{a} <> 0 then greatest({t0}, {t1}) when {inside} then 1e300 else -1e300 end"


@query(f""", {RAYS}, hits as (select r.ray_id, p.x, p.y, p.z, greatest(0, {', '.join(_slab(a, 'near') for a in AXES)}) as near, least(r.max_toi, {', '.join(_slab(a, 'far') for a in AXES)}) as far
  from rays r cross join (select distinct x, y, z from pts) p)
  select ray_id, x, y, z, round(near::double, 6) as toi from (select *, row_number() over (partition by ray_id order by near, z, y, x) as k from hits where near <= far) where k = 1""")
def l3_f11_cast_rays(spark, sf):
    return rounded(search.cast_rays(rays(spark, sf), part_points(spark, sf).distinct(), ChunkSpec((4, 4, 4))), "toi")


def _walk_sql(n: int) -> str:
    """The walk in single precision: of equal crossings the later axis goes first."""
    first = ", ".join(f"floor(s{a})::bigint as {a}, case when v{a} >= 0 then 1 else -1 end as d{a}, case when v{a} = 0 then 'inf'::float else 1::float / abs(v{a}::float) end as e{a}, case when v{a} = 0 then 'inf'::float else ((floor(s{a}) + case when v{a} >= 0 then 1 else 0 end)::float - s{a}::float) / v{a}::float end as t{a}" for a in AXES)
    goes = {"z": "tz <= ty and tz <= tx", "y": "not (tz <= ty and tz <= tx) and ty <= tx", "x": "not (tz <= ty and tz <= tx) and not ty <= tx"}
    moved = ", ".join(f"{a} + case when {goes[a]} then d{a} else 0 end, d{a}, e{a}, case when {goes[a]} then (t{a} + e{a})::float else t{a} end" for a in AXES)
    names = ", ".join(f"{a}, d{a}, e{a}, t{a}" for a in AXES)
    return f"""select ray_id, step, x, y, z from (with recursive walk(ray_id, step, {names}) as (select ray_id, 0, {first} from rays
      union all select ray_id, step + 1, {moved} from walk where step + 1 < {n}) select ray_id, step::integer as step, x, y, z from walk)"""


@query(f", {RAYS} {_walk_sql(12)}")
def l1_ray_cells(spark, sf):
    return search.ray_cells(rays(spark, sf), 12)


BALL = 0.75


def _ball_sql() -> str:
    """Least time at which the centre enters one of three grown boxes, twelve cylinders or eight balls."""
    times = []
    for grown in AXES:
        near, far = [], []
        for a in AXES:
            lo, hi = (f"(q{a} + {BALL})", f"(q{a} - 1 - {BALL})") if a == grown else (f"q{a}", f"(q{a} - 1)")
            t0, t1, inside = f"-{lo} / v{a}", f"-{hi} / v{a}", f"{lo} >= 0 and {hi} <= 0"
            near.append(f"case when v{a} <> 0 then least({t0}, {t1}) when {inside} then 0 else 1e300 end")
            far.append(f"case when v{a} <> 0 then greatest({t0}, {t1}) when {inside} then 1e300 else -1e300 end")
        near, far = f"greatest(0, {', '.join(near)})", f"least({', '.join(far)})"
        times.append(f"case when {near} <= {far} then {near} else 1e300 end")
    for along, corner in [*search._EDGES, *((None, c) for c in search._CORNERS)]:
        across = [(a, c) for k, (a, c) in enumerate(zip(AXES, corner)) if k != along]
        a2 = " + ".join(f"v{a} * v{a}" for a, _ in across)
        b2 = " + ".join(f"(q{a} - {c}) * v{a}" for a, c in across)
        c2 = " + ".join(f"(q{a} - {c}) * (q{a} - {c})" for a, c in across) + f" - {BALL * BALL}"
        root = f"({b2}) * ({b2}) - ({a2}) * ({c2})"
        t = f"case when {c2} <= 0 then 0 when {root} >= 0 and {b2} < 0 then (-({b2}) - sqrt(greatest(0, {root}))) / ({a2}) else 1e300 end"
        if along is not None:
            x = AXES[along]
            t = f"case when q{x} + least({t}, 1e9) * v{x} between 0 and 1 then {t} else 1e300 end"
        times.append(t)
    return f"least({', '.join(times)})"


@query(f""", {RAYS}, near as (select r.*, p.x, p.y, p.z, r.sx - p.x as qx, r.sy - p.y as qy, r.sz - p.z as qz from rays r join (select distinct x, y, z from pts) p
    on p.x between least(r.sx, r.sx + 30 * r.vx) - 2 and greatest(r.sx, r.sx + 30 * r.vx) + 1 and p.y between least(r.sy, r.sy + 30 * r.vy) - 2 and greatest(r.sy, r.sy + 30 * r.vy) + 1 and p.z between -5 and 28
    and abs((p.x + 0.5 - r.sx) - r.vx * (p.z + 0.5 - r.sz)) <= 3 and abs((p.y + 0.5 - r.sy) - r.vy * (p.z + 0.5 - r.sz)) <= 3)
  select ray_id, x, y, z, toi from (select *, row_number() over (partition by ray_id order by toi, z, y, x) as k from (select *, round(t, 6) as toi from (select *, {_ball_sql()} as t from near) where t <= max_toi)) where k = 1""")
def l4_cast_balls(spark, sf):
    return search.cast_balls(rays(spark, sf), part_points(spark, sf).distinct(), BALL, ChunkSpec((4, 4, 4)))


@query("""select x, y, z from (with recursive seed as (select x, y, z from sdf where v < 0 order by z, y, x limit 1), fill(x, y, z) as (select x, y, z from sdf where v < 0 and x = (select x from seed) and y = (select y from seed) and z = (select z from seed)
  union select s.x, s.y, s.z from fill f join axis3 d on true join sdf s on s.x = f.x + d.dx and s.y = f.y + d.dy and s.z = f.z + d.dz and s.v < 0 and s.x < 16 and s.y < 16 and s.z < 16) select * from fill)""")
def l6_flood_fill(spark, sf):
    box = Extent((0, 0, 0), (16, 16, 16))
    s = sdf_points(spark, sf).select(*AXES, (F.col("v") < 0).alias("solid"))
    seed = s.where("solid").orderBy("z", "y", "x").select(*AXES).first()
    return search.flood_fill(s, tuple(seed), box, "solid", ChunkSpec((8, 8, 8)))


def _grid_costs(spark, sf) -> dict:
    """Cost by point of one 16^3 block, a bounded map."""
    rows = maps.read_extent(sdf_chunks(spark, sf), SDF, Extent((0, 0, 0), (16, 16, 16))).where("v < 0.08").collect()
    return {(r.x, r.y, r.z): 1.0 + (r.x + r.y + r.z) % 3 for r in rows}


def _path_queries(spark, costs: dict) -> DataFrame:
    p = sorted(costs)
    pick = [(i, *p[i * 7 % len(p)], *p[-1 - i * 11 % len(p)]) for i in range(12)] if p else []
    return spark.createDataFrame(pick, "query_id long, sx long, sy long, sz long, fx long, fy long, fz long")


def l8_astar_paths(spark, sf):
    costs = _grid_costs(spark, sf)
    return search.astar(_path_queries(spark, costs), costs)


def l9_greedy_paths(spark, sf):
    costs = _grid_costs(spark, sf)
    return search.greedy(_path_queries(spark, costs), set(costs))


_QUERIES |= {"l8_astar_paths": l8_astar_paths, "l9_greedy_paths": l9_greedy_paths}

# meshes
def world(spark, sf) -> Extent:
    """All whole layers of stored chunks."""
    return Extent((0, 0, 0), (32, 32, table(spark, sf, "embeddings").count() // 64 * 4))


_TOP = "(select 4 * (count(*) // 64) from embeddings)"


def _vertex_sql() -> str:
    corner = [f"max(case when s.x = g.x + {i & 1} and s.y = g.y + {i >> 1 & 1} and s.z = g.z + {i >> 2 & 1} then s.v end) as c{i}" for i in range(8)]
    crossed = {(i, j): f"(c{i} < 0) <> (c{j} < 0)" for i, j in P.EDGES_3}
    n = " + ".join(f"case when {c} then 1 else 0 end" for c in crossed.values())
    below = " + ".join(f"case when c{i} < 0 then 1 else 0 end" for i in range(8))

    def axis(a):
        return " + ".join(f"case when {c} then {i >> a & 1} + c{i} / nullif(c{i} - c{j}, 0) * {(j >> a & 1) - (i >> a & 1)} else 0 end" for (i, j), c in crossed.items())

    return f"""select x, y, z, {', '.join(f"round({ax} + ({axis(a)}) / ({n}) + 0.5, 5) as p{ax}" for a, ax in enumerate(AXES))} from (
      select g.x, g.y, g.z, {', '.join(corner)} from (select x, y, z from sdf where x < 31 and y < 31 and z < {_TOP} - 1) g join sdf s on s.x between g.x and g.x + 1 and s.y between g.y and g.y + 1 and s.z between g.z and g.z + 1
      where s.x < 32 and s.y < 32 and s.z < {_TOP} group by all) where ({below}) between 1 and 7"""


@query(_vertex_sql())
def m2_surface_net_vertices(spark, sf):
    box = world(spark, sf)
    s = maps.read_extent(sdf_chunks(spark, sf), SDF, box)
    return rounded(mesh.vertices(mesh.cells(s, box)), "px", "py", "pz", digits=5).select(*AXES, "px", "py", "pz")


@query(f"""select ['x', 'y', 'z'][d.d // 2 + 1] as axis, a.x, a.y, a.z, a.v < 0 as inward from sdf a join axis3 d on d.d % 2 = 1 join sdf b on b.x = a.x + d.dx and b.y = a.y + d.dy and b.z = a.z + d.dz
  where (a.v < 0) <> (b.v < 0) and b.x < 32 and b.y < 32 and b.z < {_TOP} and a.x < 31 and a.y < 31 and a.z < {_TOP} - 1 and case d.d when 1 then a.x <> 30 and a.y <> 0 and a.z <> 0 when 3 then a.y <> 30 and a.x <> 0 and a.z <> 0 else a.z <> {_TOP} - 2 and a.x <> 0 and a.y <> 0 end""")
def m4_surface_quads(spark, sf):
    box = world(spark, sf)
    return mesh.surface_quads(maps.read_extent(sdf_chunks(spark, sf), SDF, box), box)


def m1_surface_nets(spark, sf):
    box = world(spark, sf)
    return mesh.surface_nets(maps.read_extent(sdf_chunks(spark, sf), SDF, box), box)[1]


def m13_flat_shading(spark, sf):
    box = world(spark, sf)
    flat = mesh.flat_surface_nets(maps.read_extent(sdf_chunks(spark, sf), SDF, box), box)
    return flat.withColumns({n: fields.rounded(n, 5) for n in ("px", "py", "pz", "nx", "ny", "nz")})


def m5_greedy_quads(spark, sf):
    s = part_points(spark, sf).distinct().withColumns({"m": F.floor((F.col("x") + F.col("y")) / 9), "opaque": F.lit(True)})
    return mesh.greedy_quads(s)


@query("""select ['x', 'y', 'z'][d.d // 2 + 1] as axis, case when d.d % 2 = 0 then -1 else 1 end as sign, a.x, a.y, a.z, (a.x + a.y) // 9 as value from (select distinct x, y, z from pts) a cross join axis3 d
  left join (select distinct x, y, z from pts) b on b.x = a.x + d.dx and b.y = a.y + d.dy and b.z = a.z + d.dz where b.x is null""")
def m5_cells_of_greedy_quads(spark, sf):
    """What the quads cover, each cell as often as a quad has it: the visible faces, once each."""
    q = m5_greedy_quads(spark, sf)
    cells = q.withColumn("du", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1))).withColumn("dv", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)))
    on = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    at = [(F.col(a) + sum((F.when(F.col("axis") == n, F.col("du") if a == u else F.col("dv") if a == v else F.lit(0)).otherwise(0) for n, (u, v) in on.items()), F.lit(0))).cast("long").alias(a) for a in AXES]
    return cells.select("axis", "sign", *at, F.col("value").cast("long").alias("value"))


_QUERIES |= {"m1_surface_nets": m1_surface_nets, "m13_flat_shading": m13_flat_shading, "m5_greedy_quads": m5_greedy_quads}
LAND = Extent((0, 1), (32, 30))


@query("""select c.x, c.y, round(c.h, 7) as h, round(-(r.h - l.h) / 2, 7) + 0.0 as nx, 1.0::double as ny, round(-(t.h - b.h) / 2, 7) + 0.0 as nz, (c.y - 2) * 30 + c.x - 1 as vertex
  from heights c join heights l on l.x = c.x - 1 and l.y = c.y join heights r on r.x = c.x + 1 and r.y = c.y join heights b on b.x = c.x and b.y = c.y - 1 join heights t on t.x = c.x and t.y = c.y + 1 where c.x between 1 and 30 and c.y between 2 and 29""")
def m11_h5_height_vertices(spark, sf):
    return rounded(mesh.height_vertices(heights(spark, sf), LAND), "h", "nx", "nz", digits=7)


@query("""select x, y, t::integer as t, case t when 0 then v else v + 1 end as a, v + 30 as b, case t when 0 then v + 1 else v + 31 end as c from (select p.x, p.y, (p.y - 2) * 30 + p.x - 1 as v from vert p join vert q on q.x = p.x + 1 and q.y = p.y join vert r on r.x = p.x and r.y = p.y + 1 join vert s on s.x = p.x + 1 and s.y = p.y + 1) cross join (select unnest(range(2)) as t)""")
def m11_height_triangles(spark, sf):
    return mesh.height_triangles(mesh.height_vertices(heights(spark, sf), LAND), LAND)


_SQL["m11_height_triangles"] = _SQL["m11_height_triangles"].replace("select x, y, t::integer", ", vert as (select c.x, c.y from heights c join heights l on l.x = c.x - 1 and l.y = c.y join heights r on r.x = c.x + 1 and r.y = c.y join heights b on b.x = c.x and b.y = c.y - 1 join heights t on t.x = c.x and t.y = c.y + 1 where c.x between 1 and 30 and c.y between 2 and 29) select x, y, t::integer", 1)


@query("select label, count(*) as n, coalesce(sum(count(*)) over (order by label rows between unbounded preceding and 1 preceding), 0)::bigint as first from sdf where v < 0 group by label")
def m12_mesh_append(spark, sf):
    c = sdf_chunks(spark, sf).select("label", F.explode("v").alias("v")).where("v < 0").groupBy("label").agg(F.count("*").alias("n"))
    return mesh.append(c, "label", "n")


# observers
@query("""select o.id, c.cx, c.cy, c.cz, round(sqrt((c.cx + 4 - o.x)**2 + (c.cy + 4 - o.y)**2 + (c.cz + 4 - o.z)**2), 6) as dist from obs o cross join
  (select 8*i as cx, 8*j as cy, 8*k as cz from (select unnest(range(-5, 12)) as i) cross join (select unnest(range(-5, 12)) as j) cross join (select unnest(range(-5, 12)) as k)) c
  where sqrt((c.cx + 4 - o.x)**2 + (c.cy + 4 - o.y)**2 + (c.cz + 4 - o.z)**2) < 12 + 4 * sqrt(3.0::double)""")
def n1_sphere_slots(spark, sf):
    return rounded(clipmap.sphere_slots(observers(spark, sf), ChunkSpec((8, 8, 8)), 0).drop("is_candidate"), "dist")


OBS = "obs as (select n_nationkey::bigint as id, n_nationkey::double as x, (n_regionkey * 6)::double as y, 10.0::double as z from nation)"
_SQL["n1_sphere_slots"] = _SQL["n1_sphere_slots"].replace("select o.id", f", {OBS} select o.id", 1)


def observers(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("double").alias("x"), (F.col("n_regionkey") * 6).cast("double").alias("y"), F.lit(10.0).alias("z"), F.lit(12.0).alias("r"))


@query(f""", {OBS} select o.id, c.cx, c.cy, c.cz, round(sqrt((c.cx + 4 - o.x - 3)**2 + (c.cy + 4 - o.y)**2 + (c.cz + 4 - o.z)**2), 6) as dist from obs o cross join
  (select 8*i as cx, 8*j as cy, 8*k as cz from (select unnest(range(-5, 12)) as i) cross join (select unnest(range(-5, 12)) as j) cross join (select unnest(range(-5, 12)) as k)) c
  where sqrt((c.cx + 4 - o.x - 3)**2 + (c.cy + 4 - o.y)**2 + (c.cz + 4 - o.z)**2) < 12 + 4 * sqrt(3.0::double) and not sqrt((c.cx + 4 - o.x)**2 + (c.cy + 4 - o.y)**2 + (c.cz + 4 - o.z)**2) < 12 + 4 * sqrt(3.0::double)""")
def n2_slots_entered(spark, sf):
    o = observers(spark, sf)
    return rounded(clipmap.new_slots(o, o.withColumn("x", F.col("x") + 3), ChunkSpec((8, 8, 8)), 0).drop("is_candidate"), "dist")


def levels(spark, sf) -> DataFrame:
    """Keys of the stored chunks and of all their ancestors."""
    c = sdf_chunks(spark, sf).select("lod", "cx", "cy", "cz")
    out = c
    for up in range(1, SDF.root_lod + 1):
        above = pyramid.parent_key(Vec.of("cx", "cy", "cz"), SDF, up)
        out = out.unionByName(c.select(F.lit(up).alias("lod"), *above.named("cx", "cy", "cz")).distinct())
    return out


_TREE = "tree as (" + " union all ".join(f"select distinct {k} as lod, (cx >> {2 + k}) << 2 as cx, (cy >> {2 + k}) << 2 as cy, (cz >> {2 + k}) << 2 as cz from chunks" for k in range(4)) + ")"


def _active_sql(name: str, shift: int) -> str:
    d = f"sqrt((t.cx * (1 << t.lod) + (2 << t.lod) - o.x - {shift})**2 + (t.cy * (1 << t.lod) + (2 << t.lod) - o.y)**2 + (t.cz * (1 << t.lod) + (2 << t.lod) - o.z)**2) / ((2 << t.lod) * sqrt(3.0::double))"
    return f"""{name}_fit as (select o.id, t.* from tree t cross join obs o where t.lod = 0 or {d} > 2.0),
    {name} as (select a.* from {name}_fit a where not exists (select 1 from {name}_fit b where b.id = a.id and b.lod > a.lod and b.cx = (a.cx >> (2 + b.lod - a.lod)) << 2 and b.cy = (a.cy >> (2 + b.lod - a.lod)) << 2 and b.cz = (a.cz >> (2 + b.lod - a.lod)) << 2))"""


@query(f", {OBS}, {_TREE}, {_active_sql('act', 0)} select id, lod, cx, cy, cz from act")
def n4_active_set(spark, sf):
    return clipmap.active(levels(spark, sf), observers(spark, sf), SDF, 2.0)


@query(f""", {OBS}, {_TREE}, {_active_sql('old', 0)}, {_active_sql('new', 9)}, gone as (select * from old except select * from new), come as (select * from new except select * from old),
  und as (select c.id, c.lod as fl, c.cx as fx, c.cy as fy, c.cz as fz, g.lod, g.cx, g.cy, g.cz, true as split from come c join gone g on g.id = c.id and g.lod > c.lod and g.cx = (c.cx >> (2 + g.lod - c.lod)) << 2 and g.cy = (c.cy >> (2 + g.lod - c.lod)) << 2 and g.cz = (c.cz >> (2 + g.lod - c.lod)) << 2
    union all select g.id, g.lod, g.cx, g.cy, g.cz, c.lod, c.cx, c.cy, c.cz, false from come c join gone g on g.id = c.id and c.lod > g.lod and c.cx = (g.cx >> (2 + c.lod - g.lod)) << 2 and c.cy = (g.cy >> (2 + c.lod - g.lod)) << 2 and c.cz = (g.cz >> (2 + c.lod - g.lod)) << 2)
  select id, case when split then 'Split' else 'Merge' end as change, lod, cx, cy, cz, count(*) as n from und group by all
  union all select id, 'Spawn', lod, cx, cy, cz, 0 from come c where not exists (select 1 from und u where u.id = c.id and ((u.split and u.fl = c.lod and u.fx = c.cx and u.fy = c.cy and u.fz = c.cz) or (not u.split and u.lod = c.lod and u.cx = c.cx and u.cy = c.cy and u.cz = c.cz)))""")
def n4_i5_render_changes(spark, sf):
    t, o = levels(spark, sf), observers(spark, sf)
    before, after = clipmap.active(t, o, SDF, 2.0), clipmap.active(t, o.withColumn("x", F.col("x") + 9), SDF, 2.0)
    return clipmap.changes(before, after, SDF).withColumn("n", F.size("others").cast("long")).drop("others")


@query(f""", {OBS}, {_TREE}, pend as (select 0 as lod, cx, cy, cz from chunks where label % 2 = 1 and cx >= 8 union all select lod, cx, cy, cz from tree where lod > 0 and (cx + cy) % 8 = 0),
  far as (select o.id, p.*, sqrt((p.cx * (1 << p.lod) + (2 << p.lod) - o.x)**2 + (p.cy * (1 << p.lod) + (2 << p.lod) - o.y)**2 + (p.cz * (1 << p.lod) + (2 << p.lod) - o.z)**2) as dist from pend p cross join obs o)
  select id, lod, cx, cy, cz, round(dist, 6) as dist from (select *, row_number() over (partition by id order by dist, cx, cy, cz) as r from far where lod = 0) where r <= 10
  union all select id, lod, cx, cy, cz, round(dist, 6) from far f where lod > 0 and not exists (select 1 from pend q where q.lod < f.lod and f.cx = (q.cx >> (2 + f.lod - q.lod)) << 2 and f.cy = (q.cy >> (2 + f.lod - q.lod)) << 2 and f.cz = (q.cz >> (2 + f.lod - q.lod)) << 2)""")
def n5_i4_loading_slots(spark, sf):
    low = sdf_chunks(spark, sf).select("lod", "cx", "cy", "cz", F.when(F.col("cx") >= 8, F.col("label") % 2).otherwise(0).alias("state"))
    coarse = levels(spark, sf).where("lod > 0").select("lod", "cx", "cy", "cz", F.when((F.col("cx") + F.col("cy")) % 8 == 0, 1).otherwise(0).cast("long").alias("state"))
    return rounded(clipmap.loading_slots(low.unionByName(coarse), observers(spark, sf), SDF, 10), "dist")


@query(f""", {_TREE}, want as (select distinct k as lod, (cx >> (2 + k)) << 2 as cx, (cy >> (2 + k)) << 2 as cy, (cz >> (2 + k)) << 2 as cz from chunks cross join (select unnest(range(4))::integer as k) where label = 7)
  select lod, cx, cy, cz, case when w then (s | 1) else s end::bigint as state from (select coalesce(n.lod, w.lod) as lod, coalesce(n.cx, w.cx) as cx, coalesce(n.cy, w.cy) as cy, coalesce(n.cz, w.cz) as cz, coalesce(n.state, 0) as s, w.lod is not null as w
    from (select 0 as lod, cx, cy, cz, 2::bigint as state from chunks where label < 8) n full join want w on n.lod = w.lod and n.cx = w.cx and n.cy = w.cy and n.cz = w.cz)""")
def n6_mark_for_loading(spark, sf):
    c = sdf_chunks(spark, sf)
    nodes = c.where("label < 8").select("lod", "cx", "cy", "cz", F.lit(2).cast("long").alias("state"))
    return clipmap.mark_for_loading(nodes, c.where("label = 7").select("lod", "cx", "cy", "cz"), SDF)


@query(f""", {_TREE} select c.cx, c.cy, c.cz, arg_min(t.state, t.lod) as state from chunks c left join (select *, lod * 10 + cx % 3 as state from tree where lod > 0 and (cx + cy + cz) % 8 = 0 union all select 0, cx, cy, cz, label from chunks where label < 3) t
  on t.cx = (c.cx >> (2 + t.lod)) << 2 and t.cy = (c.cy >> (2 + t.lod)) << 2 and t.cz = (c.cz >> (2 + t.lod)) << 2 group by 1, 2, 3""")
def n7_inherited_state(spark, sf):
    up = levels(spark, sf).where("lod > 0 and (cx + cy + cz) % 8 = 0").withColumn("state", (F.col("lod") * 10 + F.col("cx") % 3).cast("long"))
    own = sdf_chunks(spark, sf).where("label < 3").select("lod", "cx", "cy", "cz", F.col("label").alias("state"))
    return clipmap.inherited_state(sdf_chunks(spark, sf).select("lod", "cx", "cy", "cz"), up.unionByName(own), SDF).drop("lod")


@query(f", {_TREE} select lod, cx, cy, cz from tree where (lod = 2 and cx = 0 and cy = 4 and cz = 0) or (lod < 2 and (cx >> (4 - lod)) << 2 = 0 and (cy >> (4 - lod)) << 2 = 4 and (cz >> (4 - lod)) << 2 = 0)")
def j5_drain_subtree(spark, sf):
    return clipmap.subtree(levels(spark, sf), SDF, 2, (0, 4, 0))[0].select("lod", "cx", "cy", "cz")


@query(f", {_TREE} select p.lod, p.cx, p.cy, p.cz, count(*) as n from tree p join tree c on c.lod = p.lod - 1 and p.cx = (c.cx >> 3) << 2 and p.cy = (c.cy >> 3) << 2 and p.cz = (c.cz >> 3) << 2 group by all")
def f10_chunk_children(spark, sf):
    return clipmap.children(levels(spark, sf), SDF).groupBy("lod", "cx", "cy", "cz").agg(F.count("*").alias("n"))


@query(f", {_TREE} select lod, cx, cy, cz, cx << lod as x0, cy << lod as y0, cz << lod as z0, (cx + 4) << lod as x1, (cy + 4) << lod as y1, (cz + 4) << lod as z1 from tree")
def k4_extents_across_levels(spark, sf):
    return pyramid.extent_at_lower_lod(levels(spark, sf), SDF, 0)


# scalars
@query("""select x, y, z, x + 2*y - z as a, cast(trunc(x / 7) as bigint) as dx, cast(floor((y - 30) / 7.0) as bigint) as fy, cast(ceil((y - 30) / 7.0) as bigint) as cy, (y - 30) % 7 as my, greatest(x, y, z) as hi, least(x, y, z) as lo,
  abs(x - y) + abs(y - z) + abs(z - x) as l1, x*x + y*y + z*z as n2, x*y*z as vol, x & 12 as band, y | 3 as bor, xor(z, 5) as bxor, x << 2 as sl, (y - 30) >> 1 as sr, sign(y - 30)::bigint as sg,
  y*x - z*z as cross_x from (select distinct x, y, z from pts)""")
def o_integer_points(spark, sf):
    p, q = Vec.of(*AXES), Vec(F.col("y"), F.col("z"), F.col("x"))
    s = F.col("y") - 30
    low = Vec(s, s, s)
    return part_points(spark, sf).distinct().select(
        *AXES, p.dot(Vec(1, 2, -1)).alias("a"), p.div(F.lit(7))[0].alias("dx"), low.div_floor(F.lit(7))[0].alias("fy"), low.div_ceil(F.lit(7))[0].alias("cy"), (low % 7)[0].alias("my"), p.max_component().alias("hi"), p.min_component().alias("lo"),
        p.l1_distance(q).alias("l1"), p.norm_squared().alias("n2"), p.volume().alias("vol"), (p & F.lit(12).cast("long"))[0].alias("band"), (p | F.lit(3).cast("long"))[1].alias("bor"), (p ^ F.lit(5).cast("long"))[2].alias("bxor"), (p << 2)[0].alias("sl"), (low >> 1)[0].alias("sr"), low.signum()[0].alias("sg"),
        p.cross(q)[0].alias("cross_x"),
    )


@query("""select vec_id, round(v, 6) as v, floor(10*v)::bigint as fl, ceil(10*v)::bigint as ce, trunc(10*v)::bigint as tr, round(10*v)::bigint as ro, round(10*v - trunc(10*v), 6) + 0.0 as fr, case when v < 0 then -1.0 else 1.0 end::double as sg,
  v < 0 as neg, cast(trunc(127 * greatest(-1, least(1, v))) as tinyint) as q8, cast(trunc(32767 * greatest(-1, least(1, v))) as smallint) as q16 from (select vec_id, embedding[1]::double as v from embeddings)""")
def o9_o18_float_points(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    p = Vec(F.col("v") * 10, F.col("v"), F.col("v"))
    out = e.select("vec_id", F.col("v"), p.floor()[0].alias("fl"), p.ceil()[0].alias("ce"), p.trunc()[0].alias("tr"), p.round()[0].alias("ro"), p.fract()[0].alias("fr"), p.signum_float()[1].alias("sg"), fields.is_negative(F.col("v")).alias("neg"), fields.quantise(F.col("v")).alias("q8"), fields.quantise(F.col("v"), 16).alias("q16"))
    return rounded(out, "v", "fr")


@query("""select x, y, z, round(least(s, b), 6) + 0.0 as u, round(greatest(s, -b), 6) + 0.0 as d from (select x, y, z, sqrt((x-8)**2 + (y-8)**2 + (z-6)**2) - 5 as s,
  sqrt(greatest(abs(x-10)-3, 0)**2 + greatest(abs(y-8)-4, 0)**2 + greatest(abs(z-6)-2, 0)**2) + least(greatest(abs(x-10)-3, abs(y-8)-4, abs(z-6)-2), 0) as b
  from (select unnest(range(0, 16)) as x) cross join (select unnest(range(0, 16)) as y) cross join (select unnest(range(0, 12)) as z))""")
def o21_solid_geometry(spark, sf):
    p = scan.scan(spark, Extent((0, 0, 0), (16, 16, 12)))
    v = Vec.of(*AXES)
    s, b = fields.sphere(v, (8.0, 8.0, 6.0), 5.0), fields.box(v, (10.0, 8.0, 6.0), (3.0, 4.0, 2.0))
    return rounded(p.withColumns({"u": fields.union(s, b), "d": fields.subtract(s, b)}), "u", "d")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f5_l7_surface_points(spark, sf_dir)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
