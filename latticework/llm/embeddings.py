"""Operator 9, embedding near-dedup by an inverted multi-index.

Vectors are scaled to length 1. Each half has its own codebook; the product of both is a grid of
cells, about CELL_ROWS vectors a cell. A vector lies in the cell of its two nearest codewords and, as
a query, visits cells in the order of its summed distances to their codewords (multi-sequence order)
up to a number of its cell. Every vector is a query, so a pair is found if either finds the other: the number
of visits of a cell is the one at which, with every vector of that cell moved by as much as the threshold
allows, the share TARGET of these pairs is found from one end or the other. All that meet in a cell are
verified by their exact cosine.

Codebooks begin with as many vectors as they have codewords, the least by a fixed hash, and are fitted to all
vectors by ROUNDS rounds of k-means; visits are counted over all vectors, cell by cell, by sorting distances (k log k
a vector for k codewords, not k squared). So neither the order of ids nor a dense cluster decides for the rest. What
is shuffled is a cell, an id and the vector as it came (4 bytes an entry for floats). Equal vectors are one
node; crowded cells are split among tasks. Each dimension that occurs has a grid of its own; dimensions of up to
BRUTE_ROWS vectors are compared all with all, a task a dimension.

The result is a row an id: near_groups gives the class (all that near pairs connect, named by the smallest id) and
the number of links, those of copies counted and not listed; so rows grow as the table does. near_pairs lists them.

Defined results: null vectors, those with a null, nan or infinite entry or of length 0 have no pairs, nor do
vectors of different dimensions; such an id is a class by itself, without links; pairs are given once, the smaller
id first, with every pair of ids whose vectors are near; repeated rows of one id are one vector (the smallest); a
null id is never reported; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import Table, ragged, settled, spread
from latticework.llm.components import components
from latticework.llm.windows import mix

THRESHOLD, TARGET, CELL_ROWS, BRUTE_ROWS = 0.85, 0.97, 512, 4096
SPLIT_ROWS, ROUNDS = 4096, 8

SQL = """
with recursive ids as (select distinct vec_id from embeddings where vec_id is not null),
near as materialized (
  select distinct a.vec_id, b.vec_id as other_id from embeddings a join embeddings b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.85),
links as (select vec_id, count(*) as links from near group by vec_id),
reached as (
  select vec_id, vec_id as class_id from ids
  union select other_id, class_id from reached join near using (vec_id) where class_id < other_id)
select vec_id, min(class_id) as class_id, coalesce(any_value(links), 0) as links
from reached left join links using (vec_id) group by vec_id
"""


def rows(array: pa.Array, dim: int) -> np.ndarray:
    """A list column of dim entries a row, none null, as a matrix without copies."""
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Grid:
    """Two codebooks, and how many cells a query of each cell visits."""

    def __init__(self, left: np.ndarray, right: np.ndarray, visits: np.ndarray | None = None):
        self.left, self.right = left, right
        self.visits = np.ones(len(left) * len(right), dtype=np.int64) if visits is None else visits

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to its codewords, but for a number a row."""
        h = x.shape[1] // 2
        return [(book**2).sum(1) - 2 * part @ book.T for part, book in ((x[:, :h], self.left), (x[:, h:], self.right))]

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first cells of each row's multi-sequence traversal; the first of all is its own cell."""
        halves = []
        for d in self.distances(x):
            by = np.argsort(d, axis=1, kind="stable")[:, :visits]
            halves.append((by, np.take_along_axis(d, by, 1)))
        (la, ld), (ra, rd) = halves
        # only codeword ranks i, j with (i + 1)(j + 1) <= visits can be among the first
        i, j = np.nonzero(np.outer(np.arange(1, la.shape[1] + 1), np.arange(1, ra.shape[1] + 1)) <= visits)
        first = np.argsort(ld[:, i] + rd[:, j], axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(la[:, i] * len(self.right) + ra[:, j], first, 1)

    def own(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest codeword of each half of each row."""
        return tuple(d.argmin(1) for d in self.distances(x))

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Number of cells that row i visits until it has been to cell[i]."""
        ld, rd = self.distances(x)
        at, out = np.arange(len(x)), np.empty(len(x), dtype=np.int64)
        reached = ld[at, cell // len(self.right)] + rd[at, cell % len(self.right)]
        rd.sort(axis=1)
        step = max(1, 1_000_000 // len(self.left))
        for b in range(0, len(x), step):
            own = slice(b, b + step)
            # how many of the sorted right distances are within what each left one leaves: one search over
            # all rows, each moved by a multiple of what no difference reaches
            left, right = reached[own, None] - ld[own], rd[own]
            span = 2 * (max(np.abs(left).max(), np.abs(right).max()) + 1)
            lift = span * np.arange(len(left))[:, None]
            found = np.searchsorted((right + lift).ravel(), (left + lift).ravel() + 1e-12 * span, side="right").reshape(left.shape)
            out[own] = (found - (np.arange(len(left)) * right.shape[1])[:, None]).sum(1)
        return np.maximum(out, 1)


def moved(x: np.ndarray, ids: np.ndarray, threshold: float) -> np.ndarray:
    """Each row turned to cosine `threshold`, in a direction that its id draws."""
    draw = mix(ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(2 * x.shape[1], dtype=np.uint64))
    u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    away = np.sqrt(-2 * np.log(u[:, ::2])) * np.cos(2 * np.pi * u[:, 1::2])
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    return threshold * x + np.sqrt(1 - threshold**2) * away


def fit(nodes: DataFrame, grid: Grid, dim: int) -> Grid:
    """The codebooks after ROUNDS rounds of k-means over all rows of nodes (v)."""
    for _ in range(ROUNDS if grid.cells > 1 else 0):
        sent = nodes.sparkSession.sparkContext.broadcast((grid.left, grid.right))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            grid, h = Grid(*sent.value), dim // 2
            total = [np.zeros((len(book), book.shape[1] + 1)) for book in (grid.left, grid.right)]
            for batch in batches:
                x = unit(rows(batch.column(0), dim))
                for t, own, part in zip(total, grid.own(x), (x[:, :h], x[:, h:])):
                    np.add.at(t, own, np.c_[part, np.ones(len(x))])
            for half, t in enumerate(total):
                at = np.flatnonzero(np.broadcast_to(t[:, -1:] > 0, t.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), half, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(t.ravel()[at])], names=["half", "place", "s"])

        # a number a codeword and dimension
        summed = nodes.select("v").mapInArrow(sums, "half int, place int, s double").groupBy("half", "place").agg(F.sum("s").alias("s")).collect()
        books = [np.zeros((len(book), book.shape[1] + 1)) for book in (grid.left, grid.right)]
        for r in summed:
            books[r.half].flat[r.place] = r.s
        grid = Grid(*(np.where(t[:, -1:] > 0, t[:, :-1] / np.maximum(t[:, -1:], 1), book) for t, book in zip(books, (grid.left, grid.right))))
        sent.destroy()
    return grid


def calibrate(nodes: DataFrame, grid: Grid, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(visits, vectors) of every cell, from all rows of nodes (vec_id, v)."""
    sent = nodes.sparkSession.sparkContext.broadcast((grid.left, grid.right))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(*sent.value)
        for batch in batches:
            x, ids = unit(rows(batch.column(1), dim)), batch.column(0).to_numpy()
            y = moved(x, ids, threshold)
            cell, away = (a * len(grid.right) + b for a, b in (grid.own(x), grid.own(y)))
            # a pair is found from either end
            pair, n = np.unique(cell << 32 | np.minimum(grid.rank(x, away), grid.rank(y, cell)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array(pair & 0xFFFFFFFF), pa.array(n)], names=["cell", "rank", "n"])

    found = nodes.select("vec_id", "v").mapInArrow(ranks, "cell int, rank long, n long").groupBy("cell", "rank").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("rank"))
    whole = F.sum("n").over(Window.partitionBy("cell"))
    found = found.select("cell", "rank", upto.alias("upto"), whole.alias("whole"))
    # two numbers a cell: one for CELL_ROWS vectors
    least = found.where(F.col("upto") >= TARGET * F.col("whole")).groupBy("cell").agg(F.min("rank").alias("visits"), F.first("whole").alias("n")).collect()
    visits, n = np.ones(grid.cells, dtype=np.int64), np.zeros(grid.cells, dtype=np.int64)
    for r in least:
        visits[r.cell], n[r.cell] = r.visits, r.n
    return visits, n


def _nodes(embeddings: DataFrame, threshold: float) -> tuple[Table, Table, DataFrame]:
    """Vectors of ids, distinct ones with the smallest id and the number of ids, and (a, b, cosine) of near distinct ones."""
    spark = embeddings.sparkSession
    kind = "float" if embeddings.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    base = base.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)").groupBy("vec_id").agg(F.min("v").alias("v"))
    whole = Table(base)
    nodes = Table(whole.df.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("dim", F.size("v")))
    pairs = spark.createDataFrame([], "a long, b long, cosine double")
    dims = nodes.df.groupBy("dim").agg(F.count("*").alias("rows")).where("rows > 1").collect()
    few = [(r["dim"],) for r in dims if r["rows"] <= BRUTE_ROWS]
    if few:
        own = nodes.df.select("dim", "vec_id", "v").join(spark.createDataFrame(few, "dim int"), "dim", "left_semi")
        pairs = pairs.unionAll(own.groupBy("dim").applyInArrow(_all_pairs(threshold), "a long, b long, cosine double"))
    for r in dims:  # those with so many vectors that one task is not enough
        if r["rows"] > BRUTE_ROWS:
            pairs = pairs.unionAll(_grid_pairs(nodes.df.where(F.col("dim") == r["dim"]), r["dim"], r["rows"], kind, threshold))
    return whole, nodes, pairs


def near_groups(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, class_id, links): a row an id, the smallest id that pairs at or above the threshold connect it to, and how
    many other ids it has such a pair with."""
    whole, nodes, pairs = _nodes(embeddings, threshold)
    found = Table(pairs.select("a", "b"))
    roots = components(found.df)
    # a link to a node is one to each of its ids
    ends = found.df.unionAll(found.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = nodes.df.select(F.col("vec_id").alias("b"), "n")
    links = ends.join(size, "b").groupBy("a").agg(F.sum("n").alias("across"))
    known = nodes.df.select("v", F.col("vec_id").alias("node"), "n").join(links.withColumnRenamed("a", "node"), "node", "left").join(roots.df, "node", "left")
    known = known.select("v", F.coalesce("root", "node").alias("class_id"), (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    known = whole.df.join(known, "v").select("vec_id", "class_id", "links")
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    every = ids.join(known, "vec_id", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return settled(every, whole, nodes, found, roots)


def near_pairs(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, other_id, cosine) of all pairs found at or above the threshold."""
    whole, nodes, pairs = _nodes(embeddings, threshold)
    # from nodes back to ids: those of equal vectors, and all ids of two near nodes
    member = whole.df.join(nodes.df.select("v", F.col("vec_id").alias("node"), "n"), "v").select("vec_id", "node", "n")
    m1, m2 = member.select(F.col("vec_id").alias("x"), F.col("node").alias("a")), member.select(F.col("vec_id").alias("y"), F.col("node").alias("b"))
    across = pairs.join(m1, "a").join(m2, "b").select("x", "y", "cosine")
    twins = member.where("n > 1").select("vec_id", "node")
    same = twins.select(F.col("vec_id").alias("x"), "node").join(twins.select(F.col("vec_id").alias("y"), "node"), "node").where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    both = across.unionAll(same)
    return both.select(F.least("x", "y").alias("vec_id"), F.greatest("x", "y").alias("other_id"), F.round("cosine", 4).alias("cosine"))


def _near(one: np.ndarray, two: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> pa.RecordBatch:
    """(a, b, cosine) of rows of x (ids one) and y (ids two) that are near, a < b."""
    cosine = x @ y.T
    i, j = np.nonzero(cosine >= threshold)
    a, b = one[i], two[j]
    other = a != b
    a, b, c = a[other], b[other], cosine[i[other], j[other]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c)], names=["a", "b", "cosine"])


def _all_pairs(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids, dim = table.column("vec_id").to_numpy(), table.column("dim")[0].as_py()
        x = unit(rows(table.column("v").combine_chunks(), dim))
        parts = [_near(ids[b : b + 1024], ids[b:], x[b : b + 1024], x[b:], threshold) for b in range(0, len(ids), 1024)]
        # a block meets itself from both sides
        return pa.Table.from_batches(parts).group_by(["a", "b"]).aggregate([("cosine", "max")]).select([0, 1, 2]).rename_columns(["a", "b", "cosine"])

    return run


def _grid_pairs(nodes: DataFrame, dim: int, count: int, kind: str, threshold: float) -> DataFrame:
    """(a, b, cosine) of near nodes (vec_id, v) of one dimension, each once."""
    spark = nodes.sparkSession
    k = int(np.ceil(np.sqrt(count / CELL_ROWS)))
    first = unit(np.array([r.v for r in nodes.orderBy(spread(F.col("vec_id")), "vec_id").limit(k).select("v").collect()]))
    half = dim // 2
    grid = fit(nodes, Grid(first[:, :half], first[:, half:]), dim)
    visits, sizes = calibrate(nodes, grid, dim, threshold)
    sent = spark.sparkContext.broadcast((grid.left, grid.right, visits))
    crowded = spark.sparkContext.broadcast({int(c): int(-(-sizes[c] // SPLIT_ROWS)) for c in np.flatnonzero(sizes > SPLIT_ROWS)})
    names = ["cell", "part", "query", "vec_id", "v"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(*sent.value)
        parts = np.ones(grid.cells, dtype=np.int64)
        for cell, n in crowded.value.items():
            parts[cell] = n
        step = max(1, 200_000 // int(grid.visits.max()))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                own = batch.slice(begin, step)
                raw, ids = rows(own.column(1), dim), own.column(0).to_numpy()
                x = unit(raw)
                left, right = grid.own(x)
                home = left * len(grid.right) + right
                many = grid.visits[home]
                cells = grid.order(x, int(many.max()))
                many = np.minimum(many, cells.shape[1])
                asked = cells[np.arange(cells.shape[1]) < many[:, None]]
                times = parts[asked]
                row = np.repeat(np.repeat(np.arange(len(ids)), many), times)
                cell = np.r_[home, np.repeat(asked, times)]
                part = np.r_[ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) % parts[home].astype(np.uint64), ragged(np.zeros(len(asked), dtype=np.int64), times).astype(np.uint64)]
                every = np.r_[np.arange(len(ids)), row]
                query = np.r_[np.zeros(len(ids), dtype=bool), np.ones(len(row), dtype=bool)]
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(every) + 1) * dim, dim, dtype=np.int32)), pa.array(raw[every].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(query), pa.array(ids[every]), v], names=names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), rows(b.column(4), dim)) for b in batches if b.num_rows]
        if not held:
            return
        key, query, ids, raw = (np.concatenate(c) for c in zip(*held))
        del held
        order = np.lexsort((query, key))
        key, query, ids = key[order], query[order], ids[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for b, e in zip(starts, np.r_[starts[1:], len(key)]):
            cut = b + int((~query[b:e]).sum())
            if cut == b:
                continue
            stored = unit(raw[order[b:cut]])
            for q in range(cut, e, 2048):
                upto = min(e, q + 2048)
                found = _near(ids[q:upto], ids[b:cut], unit(raw[order[q:upto]]), stored, threshold)
                if found.num_rows:
                    yield found

    # about 200,000 vectors a task at any size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int((sizes * (visits + 1)).sum()) // 200_000))
    placed = nodes.select("vec_id", "v").mapInArrow(place, f"cell int, part int, query boolean, vec_id long, v array<{kind}>").repartition(parts, "cell", "part")
    return placed.mapInArrow(verify, "a long, b long, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
