"""Whole jobs put together from the operators: sample, store and mesh; one step of a level-of-detail loop;
a range read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from latticework.functions.points import Vec
from latticework.model import ChunkSpec, Extent, Orthant
from latticework.operators import clipmap, maps, mesh, pyramid
from latticework.sources import scan
from latticework.sources.chunk_table import ChunkTable, read_covering, read_orthant


def sample_and_store(spark: SparkSession, path: str, spec: ChunkSpec, extent: Extent, field: Callable[[Vec], Column], top: int = 0) -> ChunkTable:
    """Sample a field over an extent, add coarser levels to `top`, and store all as a new chunk table."""
    channel = next(iter(spec.channels))
    chunks = maps.to_chunks(scan.func(spark, extent, **{channel: field}), spec)
    table = ChunkTable(spark, path, spec)
    table.create(pyramid.mip_chain(chunks, spec, top) if top else chunks)
    return table


def mesh_extent(table: ChunkTable, extent: Extent, voxel_size: float = 1.0, lod: int = 0) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of a stored field over an extent, read with the halo that meshes of
    neighbouring extents share."""
    padded = extent.padded(1)
    samples = maps.read_extent(table.read(), table.spec, padded, lod)
    return mesh.surface_nets(samples, padded, voxel_size, next(iter(table.spec.channels)))


def level_of_detail_step(chunks: DataFrame, before: DataFrame | None, observers: DataFrame, spec: ChunkSpec, detail: float) -> tuple[DataFrame, DataFrame]:
    """(active set now, changes since `before`); before is the last active set, or None at the start."""
    now = clipmap.active(chunks, observers, spec, detail)
    return now, clipmap.changes(now.where("false") if before is None else before, now, spec)


def range_read(table: ChunkTable, lod: int, extent: Extent, exact: bool = True) -> DataFrame:
    """Stored chunks whose minimum lies in an extent, by key ranges of the smallest aligned cubes of its
    shortest side."""
    exponent = max(0, min(extent.shape).bit_length() - 1)
    return read_covering(table.read(), lod, extent, exponent, exact, table.spec)


def orthant_read(table: ChunkTable, lod: int, orthant: Orthant) -> DataFrame:
    return read_orthant(table.read(), lod, orthant)
