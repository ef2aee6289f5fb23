"""Observers as streams: slots that each newly touches, from the position remembered of it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from latticework.model import ChunkSpec


def slots_of(position, radius: float, spec: ChunkSpec) -> set[tuple[int, ...]]:
    """Level 0 slots whose bounding spheres a sphere touches."""
    half = (max(spec.shape) // 2) * 3.0**0.5
    spans = [range(int((p - radius - half) // s), int((p + radius + half) // s) + 1) for p, s in zip(position, spec.shape)]
    found = set()
    for cell in product(*spans):
        gap = sum((c * s + s // 2 - p) ** 2 for c, s, p in zip(cell, spec.shape, position)) ** 0.5
        if gap < radius + half:
            found.add(tuple(c * s for c, s in zip(cell, spec.shape)))
    return found


def entered(positions: DataFrame, spec: ChunkSpec, radius: float) -> DataFrame:
    """(id, ts, cx, cy, cz) for each slot that an observer's sphere newly touches. positions: a stream
    (id, ts, x, y, z); the state of an observer is its last position, so it doesn't grow."""
    schema = "id long, ts timestamp, cx long, cy long, cz long"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(batches)).sort_values("ts")
        before = slots_of(state.get, radius, spec) if state.exists else set()
        rows, last = [], None
        for r in moves.itertuples():
            last = (float(r.x), float(r.y), float(r.z))
            now = slots_of(last, radius, spec)
            rows += [(key[0], r.ts, *c) for c in sorted(now - before)]
            before = now
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=["id", "ts", "cx", "cy", "cz"])

    return positions.groupBy("id").applyInPandasWithState(step, schema, "x double, y double, z double", "append", GroupStateTimeout.NoTimeout)


def positions(events: DataFrame, scale: float = 1.0) -> DataFrame:
    """Observers from events: a user moves along x with the value of each event."""
    return events.where("value is not null and user_id is not null").select(F.col("user_id").alias("id"), "ts", (F.col("value") * scale).alias("x"), (F.col("user_id") % 32).cast("double").alias("y"), F.lit(0.0).alias("z"))
