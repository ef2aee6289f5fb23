"""Operator 5, language identification by interpolated Kneser-Ney character models.

One model of order 5 a language, over the characters of words set between spaces (a context never
reaches over a space), is trained on documents of known language. The n-grams of all languages stand
in one sorted array of 64-bit hashes an order, with a column of log probabilities a language, so that
one binary search serves every model; contexts have their back-off weights likewise. A word's score
depends on the word alone, so each task scores a distinct word once. The language of a text is the
one of lowest cross-entropy a character; it is rejected (und) if that exceeds the language's limit,
set on held-out documents so that at most REJECT of those identified rightly are lost, plus SLACK.

Defined results: null, empty and blank texts are und, with null cross-entropy and not accepted; ties
go to the language first in order; repeated rows give equal rows; an empty table gives an empty table;
without any labelled text every text is und. Long texts are scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import Grown, Words, segments_sum, slices, spread

ORDER, SAMPLE_PER_LANGUAGE = 5, 1500
REJECT, SLACK = 0.002, 0.3
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of ' word ' for all words in a row, number of each)."""
    joined = " " + "  ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    return points, n


def grams(points: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to ORDER: (hash of the n-gram ending at each place, whether it lies in its word)."""
    place = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
    out, key = [], np.zeros(len(points), dtype=np.uint64)
    for order in range(1, ORDER + 1):
        # the character `order - 1` before the end goes in last, so a suffix's hash is that of a lower order
        back = np.zeros(len(points), dtype=np.uint64)
        back[order - 1 :] = points[: len(points) - order + 1]
        key = (key ^ (back + np.uint64(order << 40))) * _MIX
        key ^= key >> np.uint64(29)
        out.append((key.copy(), place >= order - 1))
    return out


def contexts(keys: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For orders 2 to ORDER, the hash of the context: the n-gram of one order less, a place earlier."""
    return [np.r_[np.zeros(1, dtype=np.uint64), keys[order - 2][0][:-1]] for order in range(2, ORDER + 1)]


class Model:
    def __init__(self, languages: list[str], grams_, logp, contexts_, backoff, floor: np.ndarray, limits: np.ndarray):
        self.languages, self.grams, self.logp, self.contexts, self.backoff, self.floor, self.limits = languages, grams_, logp, contexts_, backoff, floor, limits

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word by language, characters scored: all but the first space)."""
        k = len(self.languages)
        total, count = np.zeros((len(words), k)), np.zeros(len(words), dtype=np.int64)
        step = 20_000
        for begin in range(0, len(words), step):
            points, n = _points(words[begin : begin + step])
            keys = grams(points, n)
            before = contexts(keys)
            score = np.zeros((len(points), k), dtype=np.float32)
            first = np.cumsum(n) - n
            live = np.ones(len(points), dtype=bool)
            live[first] = False
            live = np.flatnonzero(live)
            for order in range(ORDER, 0, -1):
                here = live[keys[order - 1][1][live]]
                if len(self.grams[order - 1]) and len(here):
                    own = keys[order - 1][0][here]
                    at = np.minimum(np.searchsorted(self.grams[order - 1], own), len(self.grams[order - 1]) - 1)
                    hit = self.grams[order - 1][at] == own
                    score[here[hit]] += self.logp[order - 1][at[hit]]
                    missed = here[~hit]
                    live = np.setdiff1d(live, here[hit], assume_unique=True)
                else:
                    missed = here
                if order > 1 and len(missed) and len(self.contexts[order - 2]):
                    own = before[order - 2][missed]
                    at = np.minimum(np.searchsorted(self.contexts[order - 2], own), len(self.contexts[order - 2]) - 1)
                    known = self.contexts[order - 2][at] == own
                    score[missed[known]] += self.backoff[order - 2][at[known]]
            score[live] += self.floor
            total[begin : begin + step] = np.add.reduceat(score, first, axis=0)
            count[begin : begin + step] = n - 1
        return total, count


def train(texts: list[str], languages: list[str]) -> Model:
    """Kneser-Ney models of each language; every fifth document is held out for the limits."""
    names = sorted(set(languages))
    held = np.zeros(len(texts), dtype=bool)
    seen = Counter()
    for i, name in enumerate(languages):
        held[i] = seen[name] % 5 == 4
        seen[name] += 1
    if not names:
        return Model([], [], [], [], [], np.zeros(0, dtype=np.float32), np.zeros(0))
    per: list[dict] = []
    for name in names:
        bag: Counter = Counter()
        for i, text in enumerate(texts):
            if languages[i] == name and not held[i]:
                bag.update(text.lower().split())
        words = list(bag)
        per.append(_kneser_ney(words, np.array([bag[w] for w in words], dtype=np.float64)))
    tables = [[], [], [], []]
    vocabulary = np.unique(np.concatenate([p["grams"][0] for p in per]))
    uniform = -np.log(len(vocabulary) + 1000.0)
    floor = np.array([p["lambda0"] for p in per]) + uniform
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([p["grams"][order - 1] for p in per]))
        suffix, context = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
        for p in per:
            at = np.searchsorted(keys, p["grams"][order - 1])
            suffix[at], context[at] = p["suffix"][order - 1], p["context"][order - 1]
        if order > 1:
            ctx = np.unique(context)
            weights = np.zeros((len(ctx), len(names)), dtype=np.float32)
            for i, p in enumerate(per):
                own, value = p["weights"][order - 2]
                weights[np.searchsorted(ctx, own), i] = np.log(value)
            tables[2].append(ctx)
            tables[3].append(weights)
            lower = tables[1][-1][np.searchsorted(tables[0][-1], suffix)] + weights[np.searchsorted(ctx, context)]
        else:
            lower = np.tile(floor, (len(keys), 1))
        table = np.exp(lower.astype(np.float64))
        for i, p in enumerate(per):
            table[np.searchsorted(keys, p["grams"][order - 1]), i] += p["discounted"][order - 1]
        tables[0].append(keys)
        tables[1].append(np.log(table).astype(np.float32))
    model = Model(names, *tables, floor.astype(np.float32), np.full(len(names), np.inf))
    out = np.flatnonzero(held)
    best, cross, _ = Scorer(model).of([texts[i] for i in out])
    truth = np.array([names.index(languages[i]) for i in out], dtype=np.int64)
    right = (best == truth) & np.isfinite(cross)
    for i in range(len(names)):
        own = cross[right & (truth == i)]
        if len(own):
            model.limits[i] = np.quantile(own, 1 - REJECT, method="higher") + SLACK
    return model


def _kneser_ney(words: list[str], times: np.ndarray) -> dict:
    """Per order, sorted n-gram hashes with their suffixes, contexts and discounted shares; and the
    back-off weight of each context."""
    points, n = _points(words) if words else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    keys = grams(points, n)
    before = contexts(keys)
    times = np.repeat(times, n)
    place = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
    out: dict = {"grams": [None] * ORDER, "suffix": [None] * ORDER, "context": [None] * ORDER, "discounted": [None] * ORDER, "weights": [None] * (ORDER - 1)}
    higher = None
    for order in range(ORDER, 0, -1):
        key, inside = keys[order - 1]
        inside = inside & (place > 0)  # the first space is given, not predicted
        unique, first, at = np.unique(key[inside], return_index=True, return_inverse=True)
        count = np.bincount(at, weights=times[inside], minlength=len(unique))
        suffix = (keys[order - 2][0] if order > 1 else np.zeros(len(key), dtype=np.uint64))[inside][first]
        context = (before[order - 2] if order > 1 else np.zeros(len(key), dtype=np.uint64))[inside][first]
        if higher is not None:
            # below the top, an n-gram counts the different characters that it follows; those that begin
            # a word follow nothing and keep their own counts
            continued = np.bincount(np.searchsorted(unique, higher), minlength=len(unique))
            count = np.where(continued > 0, continued, count)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        ctx, which = np.unique(context, return_inverse=True)
        whole = np.bincount(which, weights=count, minlength=len(ctx))
        kinds = np.bincount(which, minlength=len(ctx))
        taken = np.minimum(count, discount)
        lost = np.bincount(which, weights=taken, minlength=len(ctx))
        out["grams"][order - 1], out["suffix"][order - 1], out["context"][order - 1] = unique, suffix, context
        out["discounted"][order - 1] = (count - taken) / whole[which]
        if order > 1:
            out["weights"][order - 2] = (ctx, lost / whole)
        else:
            out["lambda0"] = float(np.log(max(lost.sum() / max(whole.sum(), 1), 1e-6))) if len(kinds) else 0.0
        higher = suffix
    return out


class Scorer:
    """Scores texts; remembers every word that it has met."""

    def __init__(self, model: Model):
        self.model, self.numbers = model, Words()
        self.scores, self.chars = Grown(np.float64, max(1, len(model.languages))), Grown(np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its cross-entropy, by how much the next one is worse), nan without words."""
        split = [t.lower().split() if t else [] for t in texts]
        flat = [w for s in split for w in s]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        new = self.numbers.fresh(flat)
        k = len(self.model.languages)
        if not k:
            return np.zeros(len(texts), dtype=np.int64), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
        if new:
            score, chars = self.model.words(new)
            self.scores.add(score)
            self.chars.add(chars)
        at = self.numbers.of(flat)
        total = segments_sum(self.scores.data[at], n)
        chars = segments_sum(self.chars.data[at], n)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = -total / chars[:, None]
        cross[n == 0] = np.nan
        ranked = np.sort(cross, axis=1)
        best = np.where(n > 0, np.argmin(np.nan_to_num(cross, nan=np.inf), axis=1), 0)
        return best, ranked[:, 0], ranked[:, 1] - ranked[:, 0] if k > 1 else np.full(len(texts), np.nan)


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on at most per_language documents of each language in lang, in the order of a fixed hash."""
    known = docs.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and trim(text) <> ''")
    order = Window.partitionBy("lang").orderBy(spread(F.col("doc_id")), "doc_id")
    # ids first: no text is sorted
    chosen = known.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    rows = known.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "lang")), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, predicted, cross_entropy, margin, accepted), a row a row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts, 1_000_000):
                best, cross, margin = scorer.of(texts[begin:end])
                none = ~np.isfinite(cross)
                fine = ~none & (cross <= model.limits[best]) if model.languages else np.zeros(len(best), dtype=bool)
                names = [model.languages[b] if f else UNKNOWN for b, f in zip(best, fine)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(names, type=pa.string()), pa.array(cross, mask=none), pa.array(margin, mask=~np.isfinite(margin)), pa.array(fine)],
                    names=["doc_id", "predicted", "cross_entropy", "margin", "accepted"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, predicted string, cross_entropy double, margin double, accepted boolean")
