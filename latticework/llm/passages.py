"""Operator 1, suffix-array dedup: passages of LENGTH and more words that repeat across documents.

Words are compared as they stand between blanks. Every equal pair of windows of LENGTH words has a
sampled gram in common (windows.py), whose hash is the shard key. Places whose gram is in one document
only are done. Places with one and the same context (all windows that have the gram) in two documents
repeat as a whole. The rest, one place a distinct context, go to the shard of their gram as suffixes of
one text, which external induced sorting (induced.py) orders, carrying common prefixes through the
induction: neighbours that share LENGTH words form groups, and a group with two documents is a repeated
window. A shard has about SHARD_WORDS words and may have any number: beyond MEMORY_ROWS rows its text, queues,
orders and prefixes are files in the shared folder, read in pieces. In memory are a row a context, a
ninetieth of the text, and a bounded number of pieces (induced.KEPT).

Defined results: a row a maximal run of repeated windows, as [begin, end) in words; documents of fewer
than LENGTH words, null and empty texts have none; repeats inside one document alone don't count, nor
do those among rows of one doc_id; ties between other documents go to the smallest; a null doc_id takes no
part; an empty table gives no rows; other columns don't matter. Words are 64-bit hashes where grams and
contexts meet and 31-bit in a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import induced, windows
from latticework.llm.common import Table, ragged, settled, shared_uri, slices

LENGTH = windows.LENGTH
SHARD_WORDS, MEMORY_ROWS = 500_000, 1 << 17

_PLACE = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("ctx", pa.int64()), ("back", pa.int32()), ("size", pa.int32())])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = windows.Codes()
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for begin, end in slices(texts):
            split = [t.split() for t in texts[begin:end]]
            split = [s if len(s) >= LENGTH else [] for s in split]
            n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            text, place, gram, context, back, size = windows.sample(codes.of([w for s in split for w in s]), n)
            found = [ids[begin:end][text], place.astype(np.int32), gram.view(np.int64), context.view(np.int64), back.astype(np.int32), size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_PLACE)


_NEED = "h long, ctx long, lo long, hi long, back int, size int, codes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word codes of the wanted contexts of each document. Where rows share a doc_id, a context is taken
    from the text that has it."""
    codes = windows.Codes()
    for batch in batches:
        wanted = batch.column(1)
        bounds, flat = wanted.offsets.to_numpy(), wanted.values
        h, ctx, lo, hi, pos, back, size = (flat.field(i).to_numpy() for i in range(7))
        kept, words, held = [], [], 0
        texts = batch.column(0).to_pylist()
        for i, text in enumerate(texts):
            own = codes.of(text.split())
            rows = np.arange(bounds[i], bounds[i + 1])
            begin, n = (pos[rows] - back[rows]).astype(np.int64), size[rows].astype(np.int64)
            fits = begin + n <= len(own)
            rows, begin, n = rows[fits], begin[fits], n[fits]
            right = windows.context_hash(windows.Prefix(own), begin, begin + n, back[rows].astype(np.int64)).view(np.int64) == ctx[rows]
            rows, begin, n = rows[right], begin[right], n[right]
            if len(rows):
                kept.append(rows)
                words.append((own >> np.uint64(32)).astype("<u4")[ragged(begin, n)])
                held += len(words[-1])
            if held > 500_000:
                yield _packed(np.concatenate(kept), np.concatenate(words), (h, ctx, lo, hi, back, size))
                kept, words, held = [], [], 0
        if kept:
            yield _packed(np.concatenate(kept), np.concatenate(words), (h, ctx, lo, hi, back, size))


def _packed(rows: np.ndarray, words: np.ndarray, columns: tuple) -> pa.RecordBatch:
    offsets = np.r_[0, np.cumsum(columns[-1][rows], dtype=np.int64) * 4].astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
    return pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in columns), binary], names=["h", "ctx", "lo", "hi", "back", "size", "codes"])


#: Symbols of a shard: ends of contexts below, words from here on.
_WORDS = 1 << 31


class Shard:
    """Contexts of one shard as a text on disk, each with an end of its own, smaller than all words; the last end is the
    smallest."""

    def __init__(self, limit: int, folder: str | None):
        self.store = induced.Store(limit, folder)
        self.text, self.contexts, self.sizes = induced.Rows(self.store), 0, []

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        """Contexts of n words each, their 32-bit codes in a row."""
        ends = np.cumsum(n + 1) - 1
        text = np.empty(len(codes) + len(n), dtype=np.int64)
        text[ends] = _WORDS - 1 - self.contexts - np.arange(len(n))
        inner = np.ones(len(text), dtype=bool)
        inner[ends] = False
        text[inner] = _WORDS + (codes.astype(np.int64) >> 1)
        self.text.append(text)
        self.contexts += len(n)
        self.sizes.append(np.asarray(n, dtype=np.int64))

    def windows(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (context, place, smallest and largest document) of repeated windows, in that order."""
        n = np.concatenate(self.sizes)
        ends = np.cumsum(n + 1) - 1
        found = induced.Rows(self.store, 4)
        ranked = induced.suffix_order(self.text, 2 * _WORDS)
        self.text.drop()
        held: list[np.ndarray] = []  # rows of a group that goes on

        def close(rows: np.ndarray, first: np.ndarray) -> None:
            starts = np.flatnonzero(first)
            c = np.searchsorted(ends, rows)
            low, high = np.minimum.reduceat(lo[c], starts), np.maximum.reduceat(hi[c], starts)
            group = np.cumsum(first) - 1
            # a context of several documents is a group by itself, also where no whole window begins
            hit = (low != high)[group] & (rows + LENGTH <= ends[c])
            c = c[hit]
            found.append(np.c_[c, rows[hit] - (ends[c] - n[c]), low[group][hit], high[group][hit]])

        for _, piece in ranked.pieces():
            rows, same = piece[:, 0], piece[:, 1] >= LENGTH
            fresh = np.flatnonzero(~same)
            if not len(fresh):
                held.append(rows.copy())
                continue
            cut = int(fresh[-1])
            own = np.concatenate([*held, rows[:cut]])
            if len(own):
                first = np.r_[np.zeros(len(own) - cut, dtype=bool), ~same[:cut]]
                first[0] = True
                close(own, first)
            held = [rows[cut:].copy()]
        own = np.concatenate(held)
        close(own, np.r_[True, np.zeros(len(own) - 1, dtype=bool)])
        ranked.drop()
        # by context: boxes of consecutive contexts, each sorted in memory
        many = max(1, -(-found.n // max(1, self.store.limit)))
        boxes = [induced.Rows(self.store, 4, max(64, self.store.limit // many)) for _ in range(many)]
        for _, piece in found.pieces():
            box = piece[:, 0] * many // len(n)
            for b in np.unique(box):
                boxes[b].append(piece[box == b])
        found.drop()
        for box in boxes:
            rows = box.slice(0, box.n)
            if len(rows):
                yield rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            box.drop()

    def close(self) -> None:
        self.store.close()


_FOUND = "h long, ctx long, b int, e int, lo long, hi long"
_FOUND_NAMES = ["h", "ctx", "b", "e", "lo", "hi"]


def _sort_shard(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept = None, []
        try:
            for batch in batches:
                if batch.num_rows:
                    shard = shard or Shard(limit, folder)
                    kept.append([batch.column(i).to_numpy() for i in range(6)])
                    codes = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype="<u4")
                    shard.add(codes, kept[-1][5].astype(np.int64))
            if shard is None:
                return
            h, ctx, lo, hi, back, _ = (np.concatenate(x) for x in zip(*kept))
            del kept
            for rows in shard.windows(lo, hi):
                c, place, low, high = rows.T
                first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (place[1:] != place[:-1] + 1)])
                last = np.r_[first[1:], len(c)] - 1
                k = c[first]
                columns = [h[k], ctx[k], (place[first] - back[k]).astype(np.int32), (place[last] + LENGTH - back[k]).astype(np.int32), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_FOUND_NAMES)
        finally:
            if shard is not None:
                shard.close()

    return run


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end, words, other_doc_id): passages that another document has too."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").where(F.length("text") >= 2 * LENGTH - 1)
    # all that follows up to `hot` and its classes is one shuffle by gram
    by_gram = Window.partitionBy("h")
    places = base.mapInArrow(_sample, "doc_id long, pos int, h long, ctx long, back int, size int")
    hot = Table(places.withColumn("lo", F.min("doc_id").over(by_gram)).withColumn("hi", F.max("doc_id").over(by_gram)).where("lo <> hi").drop("lo", "hi"))
    classes = hot.df.groupBy("h", "ctx").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "pos", "back", "size")).alias("rep"))
    classes = Table(classes.withColumn("kinds", F.count("*").over(by_gram)).select("h", "ctx", "lo", "hi", "kinds", F.col("rep.doc_id").alias("doc_id"), F.col("rep.pos").alias("pos"), F.col("rep.back").alias("back"), F.col("rep.size").alias("size")))
    solved = classes.df.where("lo <> hi").select("h", "ctx", (-F.col("back")).alias("b"), (F.col("size") - F.col("back")).alias("e"), "lo", "hi")
    need = classes.df.where("kinds > 1")
    wanted = Table(need.groupBy("doc_id").agg(F.collect_list(F.struct("h", "ctx", "lo", "hi", "pos", "back", "size")).alias("wanted")).withColumnRenamed("doc_id", "doc_id_"))
    # the arrays grow with the input, so this side is never broadcast
    texts = base.hint("merge").join(wanted.df, F.col("doc_id") == F.col("doc_id_")).select("text", "wanted")
    words = need.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // SHARD_WORDS))
    folder = shared_uri(spark) + "/suffix-runs"
    found = texts.mapInArrow(_contexts, _NEED).repartition(parts, "h").mapInArrow(_sort_shard(folder, MEMORY_ROWS), _FOUND)
    found = Table(found.unionAll(solved))
    wanted.drop()
    other = F.when(F.col("lo") != F.col("doc_id"), F.col("lo")).otherwise(F.col("hi"))
    spans = hot.df.select("doc_id", "pos", "h", "ctx").join(found.df, ["h", "ctx"]).select("doc_id", (F.col("pos") + F.col("b")).alias("b"), (F.col("pos") + F.col("e")).alias("e"), other.alias("other")).where("other <> doc_id")
    spans = spans.groupBy("doc_id", "b", "e").agg(F.min("other").alias("other"))
    order = Window.partitionBy("doc_id").orderBy("b", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(before.isNull() | (F.col("b") > before), 1).otherwise(0))
    spans = spans.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "run").agg(F.min("b").alias("begin"), F.max("e").alias("end"), F.min("other").alias("other_doc_id"))
    return settled(merged.select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("words"), "other_doc_id"), hot, classes, found)
