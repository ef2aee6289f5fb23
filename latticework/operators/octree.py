"""Hierarchical occupancy sets: octants of power-of-two edges over sets of points.

A set is a table of distinct points; its octree is a table of nodes (level, x, y, z, mask, is_full),
level 0 being voxels, rolled up one level at a time by one aggregation. Set algebra works on points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.points import Vec
from latticework.model import AXES, Extent
from latticework.operators.plumbing import Table
from latticework.operators.maps import in_extent
from latticework.sources.scan import scan


def add_extent(points: DataFrame, extent: Extent) -> DataFrame:
    """The set with a box: what is outside stays, the box comes from a scan, so no row meets another."""
    return points.where(~in_extent(extent)).select(*AXES).unionByName(scan(points.sparkSession, extent))


def subtract_extent(points: DataFrame, extent: Extent) -> DataFrame:
    return points.where(~in_extent(extent))


def empty(spark) -> DataFrame:
    return scan(spark, Extent((0, 0, 0), (0, 0, 0)))


def full(spark, extent: Extent) -> DataFrame:
    edge = extent.shape[0]
    if len(set(extent.shape)) > 1 or edge & edge - 1 or not 2 <= edge <= 64:
        raise ValueError("an octree's edge is a power of two from 2 to 64")
    return scan(spark, extent)


def roll_up(points: DataFrame, levels: int) -> DataFrame:
    """All nodes up to `levels`, with minimum corners in voxels. mask: which children exist; a node is
    full if its eight children are."""
    level = points.select(F.lit(0).alias("level"), *AXES, F.lit(0).cast("long").alias("mask"), F.lit(True).alias("is_full")).distinct()
    out = level
    for k in range(1, levels + 1):
        corner = sum((F.shiftleft(F.shiftright(a, k - 1).bitwiseAND(F.lit(1).cast("long")), i) for i, a in enumerate(AXES)), F.lit(0).cast("long"))
        up = [F.col(a).bitwiseAND(F.lit(~((1 << k) - 1)).cast("long")).alias(a) for a in AXES]
        bit = F.pow(F.lit(2), corner).cast("long")
        up_one = level.groupBy(*up).agg(F.bit_or(bit).alias("mask"), (F.sum(F.col("is_full").cast("int")) == 8).alias("is_full")).select(F.lit(k).alias("level"), *AXES, "mask", "is_full")
        level = Table(up_one).df  # each level is made once
        out = out.unionByName(level)
    return out


def branches_and_leaves(nodes: DataFrame, levels: int) -> DataFrame:
    """Branches, and full octants that no larger full octant has: what a walk that stops at full
    octants sees."""
    up = nodes.where("is_full").select(*[F.col(a).alias(f"p{a}") for a in AXES], (F.col("level") - 1).alias("level"))
    parent = F.pow(F.lit(2), F.col("level") + 1).cast("long")
    keyed = nodes.withColumns({f"p{a}": F.col(a) - F.pmod(F.col(a), parent) for a in AXES})
    return keyed.join(up, ["level", "px", "py", "pz"], "left_anti").select("level", *AXES, "mask", "is_full").where((F.col("level") > 0) | F.col("is_full"))


def overlapping(nodes: DataFrame, extent: Extent) -> DataFrame:
    """Nodes whose octant overlaps the extent."""
    edge = F.pow(F.lit(2), F.col("level")).cast("long")
    p = Vec.of(*AXES)
    return nodes.where(p.less(Vec(*extent.lub)) & Vec(*extent.minimum).less(p + Vec(edge, edge, edge)))


def location_code(levels: int) -> Column:
    """Path code of a node: 1 at the root of `levels`, then three bits a level."""
    code = F.lit(1).cast("long")
    for k in range(levels - 1, -1, -1):
        octant = sum((F.shiftleft(F.shiftright(a, k).bitwiseAND(F.lit(1).cast("long")), i) for i, a in enumerate(AXES)), F.lit(0).cast("long"))
        code = F.when(F.col("level") <= k, F.shiftleft(code, 3).bitwiseOR(octant)).otherwise(code)
    return code


def preorder(levels: int) -> Column:
    """Sorts nodes like a walk from the root, parents first: the path padded to full depth, then size."""
    return F.struct((location_code(levels) * F.pow(F.lit(8), "level").cast("long")).alias("path"), (-F.col("level")).alias("depth"))


def expand(nodes: DataFrame) -> DataFrame:
    """The points of octants, each once for disjoint octants."""
    edge = F.pow(F.lit(2), F.col("level")).cast("long")
    out = nodes.where("is_full")
    for a in AXES:
        out = out.withColumn(a, F.explode(F.sequence(F.col(a), F.col(a) + edge - 1)))
    return out.select(*AXES)


def descendants(octants: DataFrame) -> DataFrame:
    """Sub-octants of full octants on every level, themselves included."""
    out = octants.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("level"))))
    edge, own = F.pow(F.lit(2), F.col("level")).cast("long"), F.pow(F.lit(2), F.col("sub")).cast("long")
    for a in AXES:
        out = out.withColumn(a, F.explode(F.sequence(F.col(a), F.col(a) + edge - 1, own)))
    return out.select(F.col("sub").alias("level"), *AXES)


def children(nodes: DataFrame) -> DataFrame:
    """Existing children of nodes, through their masks."""
    half = F.pow(F.lit(2), F.col("level") - 1).cast("long")
    out = nodes.where("level > 0").withColumn("corner", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    out = out.where(F.expr("getbit(mask, corner)") == 1)
    return out.select((F.col("level") - 1).alias("level"), *[(F.col(a) + F.shiftright("corner", i).bitwiseAND(F.lit(1)) * half).alias(a) for i, a in enumerate(AXES)], "corner")
