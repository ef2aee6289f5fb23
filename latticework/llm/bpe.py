"""Operator 10, byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

A text is cut by the vocabulary's pattern into pre-tokens. The distinct ones that a task has not met
before are put into matrices of similar length, a row each, and in every round each row merges its
leftmost pair of minimum rank. Ranks are found in an open-addressing hash table of id pairs; rows
that have nothing left to merge leave, and the others close the gap. Ids equal those of a reference
byte-level BPE with the same ranks. Decoding joins the bytes of the ids.

Defined results: a null text has null ids and a null count; an empty text has none and 0; any text
that is valid UTF-8 decodes to itself, whatever its length; special-token strings are ordinary text;
repeated rows each give a row; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import Grown, Words, ragged, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern published with byte-level BPE vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(1 << 30)
CELLS = 2_000_000


class Bpe:
    """Encoder and decoder of one vocabulary given as {bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # every way to make a token of two others
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        self._hash(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] < 0]
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.values[taken] = keys[free[first]], values[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, NONE if it makes none; a negative id makes none."""
        shape = left.shape
        keys = (left.astype(np.int64) << 20 | right).ravel()
        keys[((left < 0) | (right < 0)).ravel()] = -2
        out = np.full(keys.shape, NONE, dtype=np.int32)
        slot = self._slot(keys)
        live = np.flatnonzero(keys >= 0)
        for _ in range(self.probes):
            at = self.keys[slot[live]]
            hit = at == keys[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (at >= 0)]
            if not len(live):
                break
            slot[live] = slot[live] + 1 & (1 << self.bits) - 1
        return out.reshape(shape)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all tokens in a row, number of ids of each)."""
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = self.single[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        first = np.cumsum(size) - size
        ends = np.zeros(len(tokens), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bucket = np.maximum(1, np.ceil(np.log2(np.maximum(size, 1)) * 2)).astype(np.int64)
        for b in np.unique(bucket):
            members = np.flatnonzero(bucket == b)
            width = int(size[members].max())
            step = max(1, CELLS // max(1, width))
            for begin in range(0, len(members), step):
                done.extend(self._merge_rows(flat, first, size, members[begin : begin + step], width))
        for rows, ids, n in done:
            ends[rows] = n
        out = np.empty(int(ends.sum()), dtype=np.int32)
        start = np.cumsum(ends) - ends
        for rows, ids, n in done:
            out[ragged(start[rows], n)] = ids
        return out, ends

    def _merge_rows(self, flat, first, size, rows, width):
        n = size[rows].copy()
        column = np.arange(width)
        filled = column < n[:, None]
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        ids[filled] = flat[ragged(first[rows], n)]
        if width < 2:
            yield rows, ids[filled], n
            return
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)
            every = np.arange(len(rows))
            best = rank[every, at]
            over = best == NONE
            if over.any():
                kept = column < n[over][:, None]
                yield rows[over], ids[over][kept], n[over]
                go = ~over
                rows, ids, rank, n, at, best = rows[go], ids[go], rank[go], n[go], at[go], best[go]
                if not len(rows):
                    return
                widest = int(n.max())
                if widest < width:
                    width = widest
                    column = column[:width]
                    ids, rank = ids[:, :width], rank[:, : width - 1]
                every = every[: len(rows)]
            # close the gap after the merged pair
            shift = column[: width - 1] > at[:, None]
            moved = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids = np.concatenate([moved, np.full((len(rows), 1), -1, dtype=np.int32)], axis=1)
            ids[every, at] = best
            if width > 2:
                moved = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])
                rank = np.concatenate([moved, np.full((len(rows), 1), NONE, dtype=np.int32)], axis=1)
            else:
                rank = np.full((len(rows), 1), NONE, dtype=np.int32)
            n -= 1
            after = np.where(at + 1 < width, ids[every, np.minimum(at + 1, width - 1)], -1)
            rank[every, np.minimum(at, width - 2)] = np.where(at <= width - 2, self.pair_ranks(best, after), rank[every, width - 2])
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.pair_ranks(ids[some, at[some] - 1], best[some])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return Encoder(self).encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder:
    """Encodes texts and remembers the ids of every pre-token it has merged."""

    def __init__(self, bpe: Bpe):
        import regex

        self.bpe, self.find = bpe, regex.compile(PATTERN).findall
        self.words, self.ids, self.first, self.n = Words(), Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        cut = [self.find(t) for t in texts]
        flat = [w for c in cut for w in c]
        new = self.words.fresh(flat)
        if new:
            ids, n = self.bpe.merge([w.encode("utf-8") for w in new])
            self.first.add(self.ids.n + np.cumsum(n) - n)
            self.ids.add(ids)
            self.n.add(n)
        at = self.words.of(flat)
        n = self.n.data[at]
        ids = self.ids.data[ragged(self.first.data[at], n)]
        per = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        sums = np.zeros(len(cut), dtype=np.int64)
        if len(n):
            some = per > 0
            sums[some] = np.add.reduceat(n, (np.cumsum(per) - per)[some])
        return ids, sums


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with text replaced by tokens (array<int>), n_tokens and decodes (the ids give the text again).

    Columns of docs that have these names give way to the new ones.

    The vocabulary (under a MB) is read once on the driver and sent to the executors.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(load_ranks(vocabulary))
    taken = {"tokens", "n_tokens", "decodes"}
    names = [c for c in docs.columns if c != "text" and c not in taken]
    rest = docs.select(*names, F.col("text").cast("string").alias("text"))
    kept = T.StructType([f for f in rest.schema if f.name != "text"])
    schema = T.StructType([*kept, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decodes", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Bpe(sent.value))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for begin, end in slices(texts):
                own = texts[begin:end]
                ids, n = encoder.encode([t or "" for t in own])
                offsets = np.zeros(len(own) + 1, dtype=np.int32)
                np.cumsum(n, out=offsets[1:])
                null = np.array([t is None for t in own])
                listed = ids.tolist()
                same = [None if t is None else encoder.bpe.decode(listed[offsets[i] : offsets[i + 1]]) == t.encode("utf-8") for i, t in enumerate(own)]
                tokens = pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[null, False]), pa.array(ids))
                part = batch.slice(begin, end - begin)
                arrays = [part.column(i) for i, f in enumerate(part.schema) if f.name != "text"]
                yield pa.RecordBatch.from_arrays([*arrays, tokens, pa.array(n, mask=null), pa.array(same, type=pa.bool_())], names=[f.name for f in schema])

    return rest.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded with a column text made from tokens; null tokens give a null text, and bytes that are
    not UTF-8 (only possible for ids that no text encodes to) become replacement characters."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    names = [c for c in encoded.columns if c != "text"]
    rest = encoded.select(*names)
    at = names.index("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in sent.value.items()}
        for batch in batches:
            texts = [None if t is None else b"".join(bytes_of.get(i, b"") for i in t if i is not None).decode("utf-8", "replace") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*names, "text"])

    return rest.mapInArrow(run, T.StructType([*rest.schema, T.StructField("text", T.StringType())]))
