"""Chunk tables on Parquet: Morton-clustered files by level, change batches, snapshots.

A table is a folder of immutable versions: `data/at_version=<n>` holds the changes that make version n of its
parent, and `versions/` the (version, parent) rows. A version is the latest change of each key on the
way to the root, so taking a snapshot writes one small row, and reading any version needs no rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import morton
from latticework.functions.points import Vec
from latticework.model import ChunkSpec, Extent, Orthant
from latticework.operators.maps import in_extent, keys

INSERT, REMOVE = "insert", "remove"


def deltas(inserts: DataFrame, spec: ChunkSpec, removes: DataFrame | None = None) -> DataFrame:
    """Change rows (lod, key, op, channels); removes need only the key."""
    up = inserts.select("lod", *keys(spec), F.lit(INSERT).alias("op"), *spec.channels)
    return up if removes is None else up.unionByName(removes.select("lod", *keys(spec), F.lit(REMOVE).alias("op")), allowMissingColumns=True)


def clustered(chunks: DataFrame, spec: ChunkSpec, files: int | None = None) -> DataFrame:
    """Chunks with their Morton key, range-partitioned and sorted by (lod, morton)."""
    keyed = chunks.withColumn("morton", morton.morton(Vec.of(*keys(spec))))
    ranged = keyed.repartitionByRange(files, "lod", "morton") if files else keyed.repartitionByRange("lod", "morton")
    return ranged.sortWithinPartitions("lod", "morton")


def apply(chunks: DataFrame, changes: DataFrame, spec: ChunkSpec, order: str | None = None) -> DataFrame:
    """chunks after a change batch; of changes to one key the one of highest `order` holds."""
    on = ["lod", *keys(spec)]
    if order:
        last = Window.partitionBy(*on).orderBy(F.desc(order))
        changes = changes.withColumn("__r", F.row_number().over(last)).where("__r = 1")
    kept = chunks.join(changes.select(*on), on, "left_anti")
    return kept.unionByName(changes.where(F.col("op") == INSERT).select(*chunks.columns))


def in_range(morton_column, lod: int, low=None, high=None, low_open: bool = False, high_open: bool = False):
    """Predicate of range_scan, for ChunkTable.read: low and high are integers."""
    out = F.col("lod") == lod
    if low is not None:
        bound = F.lit(str(low)).cast("decimal(29,0)")
        out = out & (morton_column > bound if low_open else morton_column >= bound)
    if high is not None:
        bound = F.lit(str(high)).cast("decimal(29,0)")
        out = out & (morton_column < bound if high_open else morton_column <= bound)
    return out


def in_orthants(morton_column, lod: int, orthants):
    """Predicate of keys in any of some orthants."""
    hit = F.lit(False)
    for o in orthants:
        hit = hit | in_range(morton_column, lod, *morton.orthant_range(o))
    return hit


def range_scan(clustered_chunks: DataFrame, lod: int, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Keys between two bounds, each inclusive, exclusive or absent: comparisons that reach the scan."""
    kind = clustered_chunks.schema["morton"].dataType
    out = clustered_chunks.where(F.col("lod") == lod)
    if low is not None:
        bound = F.lit(str(low)).cast(kind)
        out = out.where(F.col("morton") > bound if low_open else F.col("morton") >= bound)
    if high is not None:
        bound = F.lit(str(high)).cast(kind)
        out = out.where(F.col("morton") < bound if high_open else F.col("morton") <= bound)
    return out


def read_orthant(clustered_chunks: DataFrame, lod: int, orthant: Orthant) -> DataFrame:
    return range_scan(clustered_chunks, lod, *morton.orthant_range(orthant))


def read_covering(clustered_chunks: DataFrame, lod: int, extent: Extent, exponent: int, exact: bool = False, spec: ChunkSpec | None = None) -> DataFrame:
    """Chunks whose minimum lies in aligned cubes covering the extent, a superset of those in the extent;
    exact keeps only the latter."""
    kind = clustered_chunks.schema["morton"].dataType
    hit = F.lit(False)
    for o in Orthant.covering(extent, exponent):
        low, high = morton.orthant_range(o)
        hit = hit | ((F.col("morton") >= F.lit(str(low)).cast(kind)) & (F.col("morton") <= F.lit(str(high)).cast(kind)))
    out = clustered_chunks.where((F.col("lod") == lod) & hit)
    return out.where(in_extent(extent, keys(spec))) if exact else out


class ChunkTable:
    """A versioned table under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, spec: ChunkSpec, codec: str = "zstd"):
        self.spark, self.path, self.spec, self.codec = spark, path.rstrip("/"), spec, codec

    def create(self, chunks: DataFrame) -> int:
        self._write(deltas(chunks, self.spec), 0)
        self.spark.createDataFrame([(0, None, 0)], "version long, parent long, seq long").coalesce(1).write.parquet(f"{self.path}/versions")
        return 0

    def _write(self, changes: DataFrame, version: int) -> None:
        clustered(changes, self.spec).write.mode("append").partitionBy("lod").option("compression", self.codec).parquet(f"{self.path}/data/at_version={version}")

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions")

    def current(self) -> int:
        return self.versions().orderBy(F.desc("seq")).first()["version"]

    def parent(self, version: int):
        return self.versions().where(F.col("version") == version).orderBy("seq").first()["parent"]

    def is_leaf(self, version: int) -> bool:
        return self.versions().where(F.col("parent") == version).isEmpty()

    def _append(self, version: int, parent) -> None:
        seq = self.versions().agg(F.max("seq")).first()[0] + 1
        self.spark.createDataFrame([(version, parent, seq)], "version long, parent long, seq long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def snapshot(self) -> int:
        """A child of the current version, which becomes current."""
        fresh = self.versions().agg(F.max("version")).first()[0] + 1
        self._append(fresh, self.current())
        return fresh

    def set_current(self, version: int) -> None:
        known = self.versions().where(F.col("version") == version).limit(1).collect()
        if not known:
            raise ValueError("no such version")
        self._append(version, known[0]["parent"])

    def commit(self, changes: DataFrame) -> None:
        """Add changes to the current version, which must have no children: a later read must not change."""
        version = self.current()
        if not self.is_leaf(version):
            raise ValueError("a version with children can't be changed")
        before = self._depth(version)
        self._write(changes.withColumn("n", F.lit(before).cast("long")), version)

    def _depth(self, version: int) -> int:
        try:
            found = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/data/at_version={version}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 1
            raise
        return 1 + (found.agg(F.max("n")).first()[0] or 0) if "n" in found.columns else 1

    def lineage(self, version: int) -> list[int]:
        """The version and its ancestors, newest first; a list of version numbers."""
        parents = {r["version"]: r["parent"] for r in self.versions().collect()}
        out = [version]
        while parents.get(out[-1]) is not None:
            out.append(parents[out[-1]])
        return out

    def storage(self) -> DataFrame:
        """(version, lod, changes, inserts, removes) of what is stored."""
        data = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        kind = lambda op: F.count_if(F.col("op") == op)
        return data.groupBy(F.col("at_version").cast("long").alias("version"), "lod").agg(F.count("*").alias("changes"), kind(INSERT).alias("inserts"), kind(REMOVE).alias("removes"))

    def delta(self, version: int) -> DataFrame:
        """The changes that make a version of its parent, the latest of each key."""
        return self._latest([version], None, True)

    def read(self, version: int | None = None, where=None) -> DataFrame:
        """The chunks of a version: of each key the latest change on the way to the root. where: a predicate on
        lod, morton and key columns, which reaches the scan, as all changes of a key satisfy it or none."""
        return self._latest(self.lineage(self.current() if version is None else version), where, False)

    def _latest(self, chain: list[int], where, removed: bool) -> DataFrame:
        data = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        if "n" not in data.columns:
            data = data.withColumn("n", F.lit(None).cast("long"))
        place = F.array_position(F.array(*[F.lit(v).cast("long") for v in chain]), F.col("at_version").cast("long"))
        on = ["lod", *keys(self.spec)]
        newest = Window.partitionBy(*on).orderBy(place, F.desc(F.coalesce("n", F.lit(0))))
        live = data.where(F.col("at_version").isin(chain))
        live = live if where is None else live.where(where)
        live = live.withColumn("__r", F.row_number().over(newest)).where("__r = 1")
        columns = ["lod", *keys(self.spec), "morton", *self.spec.channels]
        return live.select(*columns, "op") if removed else live.where(F.col("op") == INSERT).select(*columns)
