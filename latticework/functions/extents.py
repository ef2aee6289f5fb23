"""Box algebra on Columns: a box is a pair of Vecs, its minimum and its shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.points import Vec


class Box:
    def __init__(self, minimum: Vec, shape: Vec):
        self.minimum, self.shape = minimum, shape

    @staticmethod
    def from_lub(minimum: Vec, lub: Vec) -> Box:
        return Box(minimum, (lub - minimum).join(0))

    @staticmethod
    def from_corners(a: Vec, b: Vec) -> Box:
        low = a.meet(b)
        return Box(low, a.join(b) - low + 1)

    @property
    def lub(self) -> Vec:
        return self.minimum + self.shape

    @property
    def maximum(self) -> Vec:
        return self.lub - 1

    def volume(self) -> Column:
        return self.shape.volume()

    def is_empty(self) -> Column:
        return self.volume() == 0

    def contains(self, p: Vec) -> Column:
        return self.minimum.less_equal(p) & p.less(self.lub)

    def intersection(self, o: Box) -> Box:
        return Box.from_lub(self.minimum.join(o.minimum), self.lub.meet(o.lub))

    def quasi_union(self, o: Box) -> Box:
        return Box.from_lub(self.minimum.meet(o.minimum), self.lub.join(o.lub))

    def is_subset_of(self, o: Box) -> Column:
        i = self.intersection(o)
        return i.minimum.equals(self.minimum) & i.shape.equals(self.shape)

    def padded(self, by) -> Box:
        return Box(self.minimum - by, self.shape + (by + by))

    def add_to_shape(self, by) -> Box:
        return Box(self.minimum, self.shape + by)

    def with_minimum(self, m: Vec) -> Box:
        return Box(m, self.shape)

    def shifted(self, by) -> Box:
        return Box(self.minimum + by, self.shape)

    def scaled(self, by) -> Box:
        return Box(self.minimum * by, self.shape * by)

    def __lshift__(self, k: int) -> Box:
        return Box(self.minimum << k, self.shape << k)

    def __rshift__(self, k: int) -> Box:
        return Box(self.minimum >> k, self.shape >> k)

    def is_positive(self) -> Column:
        """False only if no component of the shape is positive."""
        return reduce(lambda a, b: a | b, (s > 0 for s in self.shape.parts))

    def corners(self) -> Column:
        """Array of corner structs by index 0bZYX, the far ones exclusive."""
        n = len(self.shape)
        return F.array(*[Vec(*[(self.lub if i >> a & 1 else self.minimum)[a] for a in range(n)]).struct() for i in range(1 << n)])

    def orthant(self) -> Column:
        """'ok', or the first reason why the box is no aligned power-of-two cube."""
        edge = self.shape[0]
        aligned = reduce(lambda a, b: a & b, (F.pmod(m, F.nullif(edge, F.lit(0))) == 0 for m in self.minimum.parts))
        return F.when(~self.shape.powers_of_two(), "ShapeNotPow2").when(~self.shape.is_cube(), "ShapeNotCube").when(~aligned, "Misaligned").otherwise("ok")


def float_box(minimum: Vec, shape: Vec) -> Box:
    """Smallest integer box with both floored ends of a float box."""
    low = minimum.floor()
    return Box.from_corners(low, (minimum + shape).floor())


def covering_orthants(boxes: DataFrame, exponent: int, minimum=("x", "y", "z"), lub=("x1", "y1", "z1"), into=("ox", "oy", "oz")) -> DataFrame:
    """boxes with a row for every aligned cube of edge 2^exponent that each touches."""
    out = boxes
    for m, b, o in zip(minimum, lub, into):
        out = out.where(F.col(b) > F.col(m)).withColumn(o, F.explode(F.sequence(F.shiftright(m, exponent), F.shiftright(F.col(b) - 1, exponent)))).withColumn(o, F.shiftleft(o, exponent))
    return out


def sphere_contains(c1: Vec, r1, c2: Vec, r2) -> Column:
    return (c1 - c2).norm() + r2 < r1


def spheres_intersect(c1: Vec, r1, c2: Vec, r2) -> Column:
    return (c1 - c2).norm() < r1 + r2


def sphere_box(c: Vec, r) -> tuple[Vec, Vec]:
    return c - r, Vec(*[r * 2] * len(c)) if isinstance(r, Column) else Vec(*[2 * r] * len(c))
