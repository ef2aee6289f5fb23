"""Operator 4, SimHash near-dedup by anchor-point covering.

A document's fingerprint has 192 bits: the signs of the sum of +-(1 + ln tf) over the hash bits of its
lower-cased words. Two documents are near if their fingerprints differ in at most 24 bits.

The first 184 bits form four words of 46, each a pair of 23-bit blocks; the anchors of a word are pairs
of Golay codewords, a covering code of radius 3 in each block. Two fingerprints within 4 on a word have
some point midway within 2 of either; each fingerprint is therefore replicated to every anchor within
covering radius plus 2 (about 61 anchors a word) and compared per anchor. That finds every pair within
19 bits, which has a word of at most 4, with no cap. Pairs of 20 to 24 bits may have 5 or 6 on their
nearest word and then meet with a high probability only (README: measured recall).

Equal fingerprints are one node from the start, so groups of copies cost one row. An anchor keeps
only a spanning forest of its near pairs; groups are the connected components of all of them.

A task's memory doesn't follow the input: a slot of anchors is a partition of PLACED rows or so, pairs are
compared in pieces, near ones become a forest as soon as they are many, and texts, words and bits are held
for a piece of a batch.

Defined results: null, empty and blank texts have no fingerprint and are kept; the smallest doc_id of
a group stays; rows that repeat a doc_id are one document (its smallest fingerprint); a null doc_id is
never reported; an empty table gives no pairs; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import golay
from latticework.llm.common import Grown, Table, Words, batch_of, ragged, settled, small
from latticework.llm.components import components
from latticework.llm.exact import without
from latticework.llm.windows import mix

BITS, WORD, TABLES = 192, 46, 4
#: ANCHORED: bits of any two words within which a pair meets for certain. NEAR: the definition.
ANCHORED, HALF, NEAR = 9, 2, 24
#: What a task holds: bytes of text and words of bits at once, words whose hashes are kept. RUN: words a sum.
TEXT, PIECE, VOCABULARY, RUN = 250_000, 1 << 14, 200_000, 1024

_FP = pa.schema([("doc_id", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])
_FP_DDL = "doc_id long, f0 long, f1 long, f2 long"


def word_bits(words: list[str]) -> np.ndarray:
    """24 hash bytes a word."""
    if not words:
        return np.zeros((0, 3), dtype=np.uint64)
    import xxhash

    half = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(half(b := w.encode("utf-8", "surrogatepass"), 1) + half(b, 2)[:8] for w in words), dtype="<u8").reshape(-1, 3)


def fingerprint_batch(texts: list, words: Words, hashes: Grown) -> np.ndarray:
    """(n, 3) uint64; words and hashes carry what earlier batches of the task had."""
    split = [t.lower().split() if t else [] for t in texts]
    n = np.array([len(s) for s in split], dtype=np.int64)
    flat = [w for s in split for w in s]
    hashes.add(word_bits(words.fresh(flat)))
    ids = words.of(flat)
    out = np.zeros((len(texts), 3), dtype=np.uint64)
    if not len(ids):
        return out
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), n)
    keys, tf = np.unique(doc << 40 | ids, return_counts=True)
    # whole numbers, and at most RUN words a sum, so that no order of words and no cut changes a bit
    weight = np.round(1024 * (1 + np.log(tf))).astype(np.float32)
    doc, ids = keys >> 40, keys & (1 << 40) - 1
    present, starts = np.unique(doc, return_index=True)
    whole = np.add.reduceat(weight.astype(np.float64), starts)
    lengths = np.diff(np.r_[starts, len(ids)])
    many = -(-lengths // RUN)
    of = np.repeat(np.arange(len(present)), many)
    first = starts[of] + RUN * ragged(np.zeros(len(many), dtype=np.int64), many)
    last = np.minimum(first + RUN, (starts + lengths)[of])
    total, at = np.zeros((3, len(present), 64)), 0
    while at < len(of):
        upto = int(np.searchsorted(last, first[at] + PIECE, side="right"))
        own = slice(first[at], last[upto - 1])
        h = hashes.data[ids[own]]
        for part in range(3):
            bits = np.unpackbits(h[:, part].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(total[part], of[at:upto], np.add.reduceat(bits * weight[own, None], first[at:upto] - first[at], axis=0, dtype=np.float32))
        at = upto
    for part in range(3):
        sign = (2 * total[part] > whole[:, None]).astype(np.uint8)
        out[present, part] = np.packbits(sign, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, hashes = Words(), Grown(np.uint64, 3)
    for batch in batches:
        text = batch.column("text")
        ends, begin = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(), dtype=np.int64), 0
        while begin < len(ends):
            upto = (ends[begin - 1] if begin else 0) + TEXT
            end = max(begin + 1, int(np.searchsorted(ends, upto, side="right")))
            if len(words.ids) > VOCABULARY:
                words, hashes = Words(), Grown(np.uint64, 3)
            found = fingerprint_batch(text.slice(begin, end - begin).to_pylist(), words, hashes).view(np.int64)
            yield batch_of(batch.slice(begin, end - begin), _FP, {f"f{i}": found[:, i] for i in range(3)})
            begin = end


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, f2), a row a document that has a word."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return base.where(F.col("text").rlike("\\S")).mapInArrow(_fingerprints, _FP_DDL)


def blocks(*f: np.ndarray) -> list[np.ndarray]:
    """The 23-bit blocks of two (four) or three (eight) 64-bit parts, lowest bits first."""
    bits, mask, out = [x.astype(np.uint64) for x in f], np.uint64((1 << 23) - 1), []
    for block in range(2 * (64 * len(f) // WORD)):
        part, at = divmod(23 * block, 64)
        own = bits[part] >> np.uint64(at)
        if at > 64 - 23:
            own = own | bits[part + 1] << np.uint64(64 - at)
        out.append((own & mask).astype(np.int64))
    return out


def anchors(*f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius plus HALF on any word of the parts f."""
    parts, rows, keys, n = blocks(*f), [], [], len(f[0])
    for table in range(len(parts) // 2):
        left, right = (([golay.reach(parts[2 * table + side], t) for t in range(HALF + 1)]) for side in (0, 1))
        for t, (lr, la) in enumerate(left):
            for rr, ra in right[: HALF + 1 - t]:
                many = np.bincount(rr, minlength=n)
                first = np.cumsum(many) - many
                times = many[lr]
                row = np.repeat(lr, times)
                at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]
                rows.append(row)
                keys.append(table << 24 | np.repeat(la, times) << 12 | ra[at])
    return np.concatenate(rows), np.concatenate(keys)


#: What goes to an anchor: 28 bytes, many to a blob, so that no row format and no luck with compression counts.
_PLACED = np.dtype([("anchor", "<i4"), ("f", "<u8", 3)])
CHUNK, PLACED = 1024, 400_000


def _replicate(parts: int):
    """Blobs of placed fingerprints, one a slot of anchors and chunk of fingerprints; a slot is a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                f = np.stack([part.column(f"f{i}").to_numpy().view(np.uint64) for i in range(3)], axis=1)
                row, anchor = anchors(*f.T)
                slot = (mix(anchor.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(slot, kind="stable")
                placed = np.empty(len(order), dtype=_PLACED)
                placed["anchor"], placed["f"] = anchor[order], f[row[order]]
                own, starts = np.unique(slot[order], return_index=True)
                ends = np.r_[starts[1:], len(order)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([placed[s:e].tobytes() for s, e in zip(starts, ends)], type=pa.binary())], names=["slot", "placed"])

    return run


def near_pairs(f: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the row pairs differ in at most NEAR bits."""
    return sum(np.bitwise_count(f[left, i] ^ f[right, i]).astype(np.int32) for i in range(3)) <= NEAR


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest row connected to each of n rows, by vectorised min-label propagation with halving."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        old = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(old, label):
            break
    return label


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that connect the same rows."""
    used = np.unique(np.r_[left, right])
    label = forest(len(used), np.searchsorted(used, left), np.searchsorted(used, right))
    child = np.flatnonzero(label != np.arange(len(used)))
    return used[child], used[label[child]]


def partition_edges(anchor: np.ndarray, f: np.ndarray, block: int = 1 << 18, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint rows of a, of b) of a spanning forest of all near pairs sharing an anchor. Pairs are
    compared `block` at a time; more than `most` near ones become a forest of their rows."""
    order = np.argsort(anchor, kind="stable")
    anchor, f = anchor[order], f[order]
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    lefts, rights, held = [], [], 0
    # each row against those after it in its group, in pieces of bounded size
    rest = np.repeat(starts + sizes, sizes) - np.arange(len(anchor)) - 1
    rows = np.flatnonzero(rest)
    ends = np.cumsum(rest[rows])
    done = 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + block, side="right")))
        own, n = rows[done:upto], rest[rows[done:upto]]
        left = np.repeat(own, n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = near_pairs(f, left, right)
        lefts.append(left[near])
        rights.append(right[near])
        held, done = held + len(lefts[-1]), upto
        if held > most:
            left, right = spanning(np.concatenate(lefts), np.concatenate(rights))
            # a forest has fewer edges than rows, so the next one is due after as many new pairs again
            lefts, rights, held = [left], [right], 0
    left, right = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (lefts, rights))
    if not len(left):
        return f[:0], f[:0]
    # rows of one fingerprint at several anchors are one node
    used = np.unique(np.r_[left, right])
    nodes, node = np.unique(f[used], axis=0, return_inverse=True)
    node = node.ravel()
    a, b = node[np.searchsorted(used, left)], node[np.searchsorted(used, right)]
    label = forest(len(nodes), a, b)
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


_EDGE = ["a0", "a1", "a2", "b0", "b1", "b2"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blobs = [v.as_buffer() for b in batches for v in b.column("placed")]
    if blobs:
        placed = np.concatenate([np.frombuffer(v, dtype=_PLACED) for v in blobs])
        a, b = partition_edges(placed["anchor"], placed["f"])
        both = np.concatenate([a, b], axis=1).view(np.int64)
        for begin in range(0, len(both), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[begin : begin + 50_000, i]) for i in range(6)], names=_EDGE)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) for every document in a group whose smallest doc_id is another."""
    prints = Table(fingerprints(docs))
    one = prints.df.groupBy("doc_id").agg(F.min(F.struct("f0", "f1", "f2")).alias("f")).select("doc_id", "f.*")
    nodes = Table(one.groupBy("f0", "f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    # partitions of one size at any size of the input: a node has about 61 * TABLES places
    spark, count = docs.sparkSession, nodes.df.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * 61 * TABLES // PLACED))
    placed = nodes.df.select("f0", "f1", "f2").mapInArrow(_replicate(parts), "slot int, placed binary")
    edges = Table(placed.repartitionById(parts, "slot").mapInArrow(_compare, ", ".join(f"{x} long" for x in _EDGE)).distinct())
    named = edges.df
    for side in "ab":
        names = nodes.df.select(*(F.col(f"f{i}").alias(f"{side}{i}") for i in range(3)), F.col("node").alias(side))
        named = named.join(names, [f"{side}{i}" for i in range(3)])
    roots = components(named.select("a", "b"))
    known = nodes.df.join(small(roots.df.withColumnRenamed("node", "node_"), roots.df.count()), F.col("node") == F.col("node_"), "left")
    known = known.where("n > 1 or root is not null").select("f0", "f1", "f2", F.coalesce("root", "node").alias("keep_id"))
    return settled(one.join(known, ["f0", "f1", "f2"]).where("doc_id <> keep_id").select("doc_id", "keep_id"), prints, nodes, edges, roots)


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group; columns unchanged."""
    gone = Table(near_duplicates(docs).select("doc_id").distinct())
    return without(docs, gone.df)
