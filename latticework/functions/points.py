"""Arithmetic of points as tuples of Columns; integers are BIGINT so products don't overflow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


class Vec:
    """A point of 2 or 3 Columns."""

    def __init__(self, *parts):
        self.parts = tuple(_col(p) for p in parts)

    @staticmethod
    def of(*names: str) -> Vec:
        return Vec(*(F.col(n) for n in names))

    @staticmethod
    def splat(value, dim: int = 3) -> Vec:
        return Vec(*[_col(value)] * dim)

    def __getitem__(self, i: int) -> Column:
        return self.parts[i]

    def __len__(self) -> int:
        return len(self.parts)

    def map(self, f) -> Vec:
        return Vec(*(f(p) for p in self.parts))

    def zip(self, other, f) -> Vec:
        other = other if isinstance(other, Vec) else Vec.splat(other, len(self))
        return Vec(*(f(a, b) for a, b in zip(self.parts, other.parts)))

    def named(self, *names: str) -> list[Column]:
        return [p.alias(n) for p, n in zip(self.parts, names)]

    def __add__(self, o):
        return self.zip(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self.zip(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self.zip(o, lambda a, b: a * b)

    def __neg__(self):
        return self.map(lambda a: -a)

    def __and__(self, o):
        return self.zip(o, lambda a, b: a.bitwiseAND(b))

    def __or__(self, o):
        return self.zip(o, lambda a, b: a.bitwiseOR(b))

    def __xor__(self, o):
        return self.zip(o, lambda a, b: a.bitwiseXOR(b))

    def __invert__(self):
        return self.map(F.bitwise_not)

    def __mod__(self, o):
        """Remainder with the sign of the dividend."""
        return self.zip(o, lambda a, b: a % b)

    def __lshift__(self, k: int):
        return self.map(lambda a: F.shiftleft(a, k))

    def __rshift__(self, k: int):
        return self.map(lambda a: F.shiftright(a, k))

    def div(self, o):
        """Division cut towards zero."""
        return self.zip(o, lambda a, b: F.call_function("div", a, b))

    def div_floor(self, o):
        return self.zip(o, lambda a, b: F.call_function("div", a - F.pmod(a, b), b))

    def div_ceil(self, o):
        return self.zip(o, lambda a, b: F.call_function("div", a + F.pmod(-a, b), b))

    def over(self, o):
        """Float division; by zero it gives the infinity of the dividend's sign, 0 / 0 nan."""
        inf, nan = float("inf"), float("nan")
        return self.zip(o, lambda a, b: F.when(b != 0, F.try_divide(a.cast("double"), b.cast("double"))).when(a > 0, F.lit(inf)).when(a < 0, F.lit(-inf)).otherwise(F.lit(nan)))

    def join(self, o):
        """Component-wise maximum."""
        return self.zip(o, F.greatest)

    def meet(self, o):
        """Component-wise minimum."""
        return self.zip(o, F.least)

    def less_equal(self, o) -> Column:
        """The product order: every component."""
        return reduce(lambda a, b: a & b, self.zip(o, lambda a, b: a <= b).parts)

    def less(self, o) -> Column:
        return reduce(lambda a, b: a & b, self.zip(o, lambda a, b: a < b).parts)

    def equals(self, o) -> Column:
        return reduce(lambda a, b: a & b, self.zip(o, lambda a, b: a == b).parts)

    def dot(self, o) -> Column:
        return reduce(lambda a, b: a + b, (self * o).parts)

    def cross(self, o) -> Vec:
        (a, b, c), (d, e, f) = self.parts, o.parts
        return Vec(b * f - c * e, c * d - a * f, a * e - b * d)

    def norm_squared(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm_squared().cast("double"))

    def l1_distance(self, o) -> Column:
        return reduce(lambda a, b: a + b, (self - o).map(F.abs).parts)

    def l2_distance_squared(self, o) -> Column:
        return (self - o).norm_squared()

    def distance(self, o) -> Column:
        return (self - o).norm()

    def volume(self) -> Column:
        return reduce(lambda a, b: a * b, self.parts)

    def min_component(self) -> Column:
        return F.least(*self.parts)

    def max_component(self) -> Column:
        return F.greatest(*self.parts)

    def abs(self):
        return self.map(F.abs)

    def signum(self):
        """Integers -1, 0, 1."""
        return self.map(lambda a: F.signum(a).cast("long"))

    def signum_float(self):
        """-1 or 1, never 0."""
        return self.map(lambda a: F.when(a < 0, -1.0).otherwise(1.0))

    def floor(self):
        return self.map(lambda a: F.floor(a).cast("long"))

    def ceil(self):
        return self.map(lambda a: F.ceil(a).cast("long"))

    def round(self):
        """Halves away from zero."""
        return self.map(lambda a: F.round(a).cast("long"))

    def trunc(self):
        return self.map(lambda a: a.cast("long"))

    def fract(self):
        """What trunc leaves, with its sign."""
        return self.map(lambda a: a - a.cast("long"))

    in_voxel = floor

    def powers_of_two(self) -> Column:
        return reduce(lambda a, b: a & b, ((p > 0) & (F.bit_count(p) == 1) for p in self.parts))

    def is_cube(self) -> Column:
        return reduce(lambda a, b: a & b, (p == self.parts[0] for p in self.parts))

    def swizzle(self, order: str) -> Vec:
        return Vec(*(self.parts["xyz".index(c)] for c in order))

    def struct(self) -> Column:
        return F.struct(*self.named("x", "y", "z"))


def stride(p: Vec, shape) -> Column:
    """Row-major offset of a local point, x fastest."""
    out = p[len(p) - 1]
    for a in range(len(p) - 2, -1, -1):
        out = out * shape[a] + p[a]
    return out


def from_stride(s: Column, shape) -> Vec:
    parts, rest = [], s
    for n in shape[:-1]:
        parts.append(F.pmod(rest, F.lit(n)))
        rest = F.call_function("div", rest - F.pmod(rest, F.lit(n)), F.lit(n))
    return Vec(*parts, rest)


VON_NEUMANN_3 = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
VON_NEUMANN_2 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
MOORE_3 = [(x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]
MOORE_2 = [(x, y) for y in (-1, 0, 1) for x in (-1, 0, 1) if (x, y) != (0, 0)]
CORNERS_3 = [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
CORNERS_2 = [(i & 1, i >> 1 & 1) for i in range(4)]
#: Corner index pairs of the edges of a cell.
EDGES_3 = [(i, i | 1 << a) for i in range(8) for a in range(3) if not i >> a & 1]
EDGES_2 = [(i, i | 1 << a) for i in range(4) for a in range(2) if not i >> a & 1]

#: Axis orders and whether they are even.
PERMUTATIONS = {"XYZ": 1, "ZXY": 1, "YZX": 1, "ZYX": -1, "XZY": -1, "YXZ": -1}


def neighbours(df, offsets, names=("x", "y", "z"), into=("nx", "ny", "nz")):
    """A row for every offset, the neighbour's coordinates in `into`."""
    moves = F.array(*[F.struct(*[F.lit(d).cast("long").alias(n) for d, n in zip(o, into)]) for o in offsets])
    return df.withColumn("__o", F.explode(moves)).select(*df.columns, *[(F.col(n) + F.col(f"__o.{i}")).alias(i) for n, i in zip(names, into)])
