"""Z-order keys of 32-bit coordinates as DECIMAL and as big-endian bytes, and back.

A coordinate is moved by 2^31 so that signed order is kept; its low and high 16 bits are spread in
BIGINT and put together as DECIMAL(29) (3D, 96 bits) or DECIMAL(20) (2D, 64 bits).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.points import Vec
from latticework.model import Orthant

def _spread(v: Column, dim: int) -> Column:
    """16 bits, each `dim` places from the next."""
    steps = [(16, 0xFF0000FF), (8, 0xF00F00F00F), (4, 0xC30C30C30C3), (2, 0x249249249249)] if dim == 3 else [(8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)]
    for shift, mask in steps:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _gather(v: Column, dim: int) -> Column:
    steps = [(2, 0xC30C30C30C3), (4, 0xF00F00F00F), (8, 0xFF0000FF), (16, 0xFFFF)] if dim == 3 else [(1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0xFFFF)]
    v = v.bitwiseAND(F.lit(0x249249249249 if dim == 3 else 0x55555555).cast("long"))
    for shift, mask in steps:
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def halves(p: Vec) -> tuple[Column, Column]:
    """(high, low) half of the key, each a BIGINT of 16 bits a coordinate."""
    dim = len(p)
    moved = [(c + F.lit(1 << 31)).cast("long") for c in p.parts]
    high = low = None
    for a, u in enumerate(moved):
        h, lo = F.shiftleft(_spread(F.shiftright(u, 16), dim), a), F.shiftleft(_spread(u.bitwiseAND(F.lit(0xFFFF).cast("long")), dim), a)
        high, low = (h, lo) if high is None else (high.bitwiseOR(h), low.bitwiseOR(lo))
    return high, low


def morton(p: Vec) -> Column:
    high, low = halves(p)
    kind = "decimal(29,0)" if len(p) == 3 else "decimal(20,0)"
    return (high.cast(kind) * F.lit(1 << 16 * len(p)).cast("decimal(15,0)") + low).cast(kind)


def demorton(high: Column, low: Column, dim: int = 3) -> Vec:
    return Vec(*((F.shiftleft(_gather(F.shiftright(high, a), dim), 16).bitwiseOR(_gather(F.shiftright(low, a), dim)) - F.lit(1 << 31)).cast("long") for a in range(dim)))


def split(key: Column, dim: int = 3) -> tuple[Column, Column]:
    """(high, low) halves of a DECIMAL key."""
    base = F.lit(1 << 16 * dim).cast("decimal(20,0)")
    low = (key % base).cast("long")
    return ((key - low) / base).cast("long"), low


def ord_key(lod: Column, p: Vec) -> Column:
    """Bytes that sort like (lod, key): 9 in 2D, 13 in 3D."""
    high, low = halves(p)
    digits = 4 * len(p)
    return F.unhex(F.concat(F.lpad(F.hex(lod.cast("long")), 2, "0"), F.lpad(F.hex(high), digits, "0"), F.lpad(F.hex(low), digits, "0")))


def key_of(p) -> int:
    """The key of a point known to the driver."""
    return sum((c + (1 << 31) >> i & 1) << (len(p) * i + a) for a, c in enumerate(p) for i in range(32))


def orthant_range(o: Orthant) -> tuple[int, int]:
    """First and last key of an aligned cube; all keys between lie in it."""
    low = key_of(o.minimum)
    return low, low + (1 << o.exponent * len(o.minimum)) - 1
