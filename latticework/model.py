"""Boxes and chunk layouts known to the driver; everything per point or chunk is a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

AXES = ("x", "y", "z")
KEYS = ("cx", "cy", "cz")


@dataclass(frozen=True)
class Extent:
    """Half-open box of integer points in 2 or 3 dimensions."""

    minimum: tuple[int, ...]
    shape: tuple[int, ...]

    @staticmethod
    def from_lub(minimum, lub) -> Extent:
        return Extent(tuple(minimum), tuple(max(0, b - a) for a, b in zip(minimum, lub)))

    @staticmethod
    def from_corners(a, b) -> Extent:
        """Both corners belong to the box."""
        low = tuple(map(min, a, b))
        return Extent(low, tuple(max(p, q) - m + 1 for p, q, m in zip(a, b, low)))

    @staticmethod
    def cube(minimum, edge: int) -> Extent:
        return Extent(tuple(minimum), (edge,) * len(minimum))

    @staticmethod
    def bounding(points) -> Extent:
        points = list(points)
        if not points:
            raise ValueError("no points to bound")
        return Extent.from_corners(tuple(map(min, *points, points[0])), tuple(map(max, *points, points[0])))

    @property
    def dim(self) -> int:
        return len(self.minimum)

    @property
    def lub(self) -> tuple[int, ...]:
        return tuple(m + s for m, s in zip(self.minimum, self.shape))

    @property
    def maximum(self) -> tuple[int, ...]:
        return tuple(m + s - 1 for m, s in zip(self.minimum, self.shape))

    @property
    def volume(self) -> int:
        n = 1
        for s in self.shape:
            n *= s
        return n

    def is_empty(self) -> bool:
        return self.volume == 0

    def contains(self, p) -> bool:
        return all(m <= c < b for m, c, b in zip(self.minimum, p, self.lub))

    def intersection(self, other: Extent) -> Extent:
        return Extent.from_lub(tuple(map(max, self.minimum, other.minimum)), tuple(map(min, self.lub, other.lub)))

    def quasi_union(self, other: Extent) -> Extent:
        return Extent.from_lub(tuple(map(min, self.minimum, other.minimum)), tuple(map(max, self.lub, other.lub)))

    def is_subset_of(self, other: Extent) -> bool:
        return self.intersection(other) == self

    def padded(self, by: int) -> Extent:
        return Extent(tuple(m - by for m in self.minimum), tuple(s + 2 * by for s in self.shape))

    def add_to_shape(self, by) -> Extent:
        return Extent(self.minimum, tuple(s + d for s, d in zip(self.shape, by)))

    def with_minimum(self, minimum) -> Extent:
        return Extent(tuple(minimum), self.shape)

    def positive(self) -> Extent | None:
        """None only if no component of the shape is positive."""
        return None if all(s <= 0 for s in self.shape) else self

    def corners(self) -> list[tuple[int, ...]]:
        """Corners by index 0bZYX, the far ones exclusive."""
        return [tuple((self.lub if i >> a & 1 else self.minimum)[a] for a in range(self.dim)) for i in range(1 << self.dim)]

    def points(self) -> Iterator[tuple[int, ...]]:
        """Row-major, x fastest."""
        for p in product(*(range(m, b) for m, b in zip(reversed(self.minimum), reversed(self.lub)))):
            yield p[::-1]

    def __add__(self, by) -> Extent:
        return self.with_minimum(m + d for m, d in zip(self.minimum, by))

    def __sub__(self, by) -> Extent:
        return self.with_minimum(m - d for m, d in zip(self.minimum, by))

    def scaled(self, by) -> Extent:
        return Extent(tuple(m * d for m, d in zip(self.minimum, by)), tuple(s * d for s, d in zip(self.shape, by)))

    def __lshift__(self, k: int) -> Extent:
        return Extent(tuple(m << k for m in self.minimum), tuple(s << k for s in self.shape))

    def __rshift__(self, k: int) -> Extent:
        return Extent(tuple(m >> k for m in self.minimum), tuple(s >> k for s in self.shape))


@dataclass(frozen=True)
class Orthant:
    """Power-of-two cube aligned to its edge."""

    minimum: tuple[int, ...]
    exponent: int

    @property
    def edge(self) -> int:
        return 1 << self.exponent

    @property
    def extent(self) -> Extent:
        return Extent.cube(self.minimum, self.edge)

    @staticmethod
    def of(extent: Extent) -> Orthant:
        """Raises ShapeNotPow2, then ShapeNotCube, then Misaligned, as the first that holds."""
        if any(s < 1 or s & s - 1 for s in extent.shape):
            raise ValueError("ShapeNotPow2")
        if len(set(extent.shape)) > 1:
            raise ValueError("ShapeNotCube")
        if any(m % extent.shape[0] for m in extent.minimum):
            raise ValueError("Misaligned")
        return Orthant(extent.minimum, extent.shape[0].bit_length() - 1)

    @staticmethod
    def covering(extent: Extent, exponent: int) -> list[Orthant]:
        if extent.is_empty():
            return []
        low, high = (tuple(c >> exponent for c in p) for p in (extent.minimum, extent.maximum))
        return [Orthant(tuple(c << exponent for c in p), exponent) for p in Extent.from_corners(low, high).points()]


@dataclass(frozen=True)
class ChunkSpec:
    """Shape of chunks, the value of vacant space by channel, and the coarsest level."""

    shape: tuple[int, ...] = (16, 16, 16)
    ambient: dict | tuple = (("v", 0.0),)
    root_lod: int = 0

    def __post_init__(self):
        if any(s < 1 or s & s - 1 for s in self.shape):
            raise ValueError("chunk edges must be powers of two")
        object.__setattr__(self, "ambient", tuple(dict(self.ambient).items()))

    @property
    def dim(self) -> int:
        return len(self.shape)

    @property
    def volume(self) -> int:
        return Extent((0,) * self.dim, self.shape).volume

    @property
    def channels(self) -> dict:
        return dict(self.ambient)

    def chunk_min(self, p) -> tuple[int, ...]:
        return tuple(c & ~(s - 1) for c, s in zip(p, self.shape))

    def chunk_mins(self, extent: Extent) -> list[tuple[int, ...]]:
        if extent.is_empty():
            return []
        low, high = (tuple(c // s for c, s in zip(p, self.shape)) for p in (extent.minimum, extent.maximum))
        return [tuple(c * s for c, s in zip(p, self.shape)) for p in Extent.from_corners(low, high).points()]

    def is_valid_min(self, p) -> bool:
        return all(c % s == 0 for c, s in zip(p, self.shape))

    def parent(self, lod: int, p) -> tuple[int, tuple[int, ...]]:
        return lod + 1, tuple((c & ~(2 * s - 1)) >> 1 for c, s in zip(p, self.shape))

    def child(self, lod: int, p, corner: int) -> tuple[int, tuple[int, ...]]:
        return lod - 1, tuple((c << 1) + (corner >> a & 1) * s for a, (c, s) in enumerate(zip(p, self.shape)))

    def ancestor(self, p, levels: int) -> tuple[int, ...]:
        return tuple((c & ~((s << levels) - 1)) >> levels for c, s in zip(p, self.shape))
