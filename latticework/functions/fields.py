"""Scalar fields: quantised signed distances, constructive solids, hash noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.points import Vec


def quantise(v: Column, bits: int = 8) -> Column:
    """Signed distance to a byte or short: clamped to [-1, 1], scaled, cut towards zero."""
    top, kind = (127, "tinyint") if bits == 8 else (32767, "smallint")
    return (F.lit(float(top)) * clamp(v, -1.0, 1.0)).cast(kind)


def dequantise(v: Column, bits: int = 8) -> Column:
    return v.cast("double") / (127.0 if bits == 8 else 32767.0)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def is_negative(v: Column) -> Column:
    return v < 0


def sphere(p: Vec, centre, radius: float) -> Column:
    return (p - Vec(*centre)).norm() - radius


def box(p: Vec, centre, half) -> Column:
    q = (p - Vec(*centre)).abs() - Vec(*half)
    return q.join(0.0).norm() + F.least(q.max_component(), F.lit(0.0))


def torus(p: Vec, centre, major: float, minor: float) -> Column:
    q = p - Vec(*centre)
    return Vec(Vec(q[0], q[2]).norm() - major, q[1]).norm() - minor


def union(a: Column, b: Column) -> Column:
    return F.least(a, b)


def intersect(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.greatest(a, -b)


def smooth_union(a: Column, b: Column, k: float) -> Column:
    h = clamp(0.5 + 0.5 * (b - a) / k, 0.0, 1.0)
    return b + (a - b) * h - k * h * (1.0 - h)


NOISE_FACTORS = (73_856_093, 19_349_663, 83_492_791)


def noise(p: Vec, frequency: float, seed: int, octaves: int = 1) -> Column:
    """Fractal value noise in [-1, 1] from a hash of the cell corners (two squarings modulo a prime), linear
    between them."""

    def corner(cell: Vec, s: int) -> Column:
        prime = F.lit((1 << 31) - 1).cast("long")
        h = F.pmod(sum((c.cast("long") * m for c, m in zip(cell.parts, NOISE_FACTORS)), F.lit(s * 40_503).cast("long")), prime)
        for _ in range(2):
            h = F.pmod(h * h + h * 48_271 + 11, prime)
        return F.pmod(h, F.lit(1_000_003)) / 500_001.0 - 1.0

    total, weight, norm = F.lit(0.0), 1.0, 0.0
    for o in range(octaves):
        q = p.map(lambda c: c * F.lit(frequency * 2.0**o))
        cell, t = q.floor(), q - q.floor()
        values = [corner(cell + Vec(*[i >> a & 1 for a in range(len(p))]), seed + o) for i in range(1 << len(p))]
        for a in range(len(p)):
            values = [values[i] * (1 - t[a]) + values[i + 1] * t[a] for i in range(0, len(values), 2)]
        total, norm, weight = total + values[0] * weight, norm + weight, weight / 2
    return total / norm


def rounded(name: str, digits: int) -> Column:
    """round() of a double column with the same results: its way over decimal text is left for values near a tie, where binary and
    decimal may part, and for large ones. -0.0 becomes 0.0."""
    scaled = F.col(name) * 10.0**digits
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.4999)
    return F.when(plain, whole / 10.0**digits).otherwise(F.round(name, digits)) + F.lit(0.0)
