"""Shared storage, sampling and batching used by the corpus operators.

Intermediate tables are written as Parquet under the folder named by spark.checkpoint.dir, which
every executor can reach, so that losing an executor loses no work. A folder of our own is made
only where the session names none.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 50_000
#: ... and its texts so many bytes.
BROADCAST_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            named = tempfile.mkdtemp(prefix="latticework-")
            sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_uri(spark: SparkSession) -> str:
    """The shared folder with its scheme, that of the cluster's default file system where it names none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


class Table:
    """A DataFrame written to the shared folder and read again."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.spark = spark
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, *tables: Table) -> DataFrame:
    """df written, so that the tables it was made from can go."""
    out = Table(df)
    for table in tables:
        table.drop()
    return out.df


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a counted side of narrow rows for broadcast when it is small; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fitting(table: Table, *wide: str | Column) -> DataFrame:
    """A written side, marked for broadcast when its rows are few and short: wide names columns of any length,
    or gives bytes a row."""
    length = sum((F.coalesce(F.octet_length(c) if isinstance(c, str) else c, F.lit(0)) for c in wide), F.lit(0))
    rows, size = table.df.agg(F.count("*"), F.coalesce(F.sum(length.cast("long")), F.lit(0))).first()
    return F.broadcast(table.df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table.df


def spread(column: Column) -> Column:
    """A fixed pseudo-random order of rows, equal on every run."""
    return F.xxhash64(column.cast("string"), F.lit(2_654_435_761))


def labelled_sample(labels: DataFrame, docs: DataFrame, label: str, per_class: tuple[int, int]) -> DataFrame:
    """At most per_class[v] documents with the value v of a 0/1 label, in the order of a fixed hash.

    Rows with a null id, label or text don't take part. The bound is a parameter of every caller.
    """
    from pyspark.sql import Window

    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    named = named.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = Window.partitionBy("label", "slot").orderBy(spread(F.col("doc_id")), "doc_id")
    slots = 16
    named = named.withColumn("slot", F.pmod(spread(F.col("doc_id")), F.lit(slots)))
    chosen = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.when(F.col("label") == 0, max(1, per_class[0] // slots)).otherwise(max(1, per_class[1] // slots)))
    chosen = F.broadcast(chosen.select("doc_id", "label"))  # sum(per_class) rows at most
    return docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").dropDuplicates(["doc_id"])


def slices(texts: list, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of about so many characters, at least one text each."""
    begin = total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > begin and total + n > chars:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def give_back() -> None:
    """Freed memory of this process goes back to the system, where the C library has a call for that (glibc); otherwise it
    may be kept for as long as the process runs."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def segments_max(values: np.ndarray, lengths: np.ndarray, empty: float) -> np.ndarray:
    """Maximum of consecutive runs of the given lengths; `empty` for runs of none."""
    out = np.full(len(lengths), empty, dtype=np.float64)
    some = lengths > 0
    if some.any():
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some] = np.maximum.reduceat(values, starts)
    return out


def segments_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows of the given lengths."""
    out = np.zeros((len(lengths), *values.shape[1:]), dtype=np.float64)
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some], axis=0)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the index ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


class Words:
    """Numbers words as they come; fresh() gives those not seen before."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def fresh(self, words: list[str]) -> list[str]:
        new = list(set(words).difference(self.ids))
        first = len(self.ids)
        self.ids.update(zip(new, range(first, first + len(new))))
        return new

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))


class Grown:
    """An array that doubles as rows are appended."""

    def __init__(self, dtype, width: int = 0):
        self.data, self.n = np.zeros((1024, width) if width else 1024, dtype=dtype), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), dtype=self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : need] = rows
        self.n = need


def batch_of(batch: pa.RecordBatch, schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch of new columns beside those of the batch that the schema names."""
    arrays = []
    for field in schema:
        found = columns[field.name] if field.name in columns else batch.column(field.name)
        arrays.append(found if isinstance(found, (pa.Array, pa.ChunkedArray)) else pa.array(found, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
