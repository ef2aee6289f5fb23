"""Operator 3, toxicity by a subsequence string-kernel SVM with Nystrom landmarks, trained on labelled sentences.

Strings: a text is a row of letters and word boundaries. Digits and marks that stand for a letter count as it
("1diot"), other marks inside a word vanish ("i.d.i.o.t"), and runs of three and more single letters are one
word ("i d i o t"). The windows of a sentence are its words and its pairs of neighbouring words, so that
insults of two words and insults cut in two can be learned and found; of a word of more than PIECE letters
they are its half-overlapping pieces.

Kernel: windows are compared by the subsequences of 3 and 4 symbols that lie within 5 positions, each
weighted LAMBDA to the power of its span, so that gaps and inserted characters only lower the match;
it is normalised by the lengths of both. A few hundred landmark windows span the Nystrom feature space, in
which a linear SVM (squared hinge, Newton steps) is trained. Since every landmark is itself a sum over
subsequences, the trained machine folds into one weight a hashed subsequence, and a text is scored by sums of
weights over its windows without touching the landmarks.

Labelled sentences: labels are of documents. A sentence of a toxic document is a toxic example if it has a
telling window: one that toxic documents of the sample have again and again and clean ones hardly ever, or a
word that clean ones don't have with a stem of that kind. The sentences of clean documents are clean examples.
A sentence is an example by its worst window (multiple-instance SVM): telling windows begin as those of toxic
sentences, and each round takes the highest-scoring one of each sentence anew; windows of clean sentences that
score too high join the CLEAN_WINDOWS drawn by hash, all of them. A document scores as its worst sentence.
The threshold is set on documents held out from training: in the gap above all but a share MAX_FALSE of the
clean ones.

Defined results: null and empty texts and those without letters score null and are not toxic; repeated rows
and ties score alike; without both labels to train on nothing is toxic; an empty table gives an empty table;
extra columns pass through where documents are filtered. Long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import give_back, labelled_sample, ragged, segments_max, slices

#: Bounds of the labelled sample: clean and toxic documents, and clean windows drawn by hash before hard ones join.
SAMPLE, CLEAN_WINDOWS = (4000, 2000), 12_000
LANDMARKS, LAMBDA, SPAN, HASHED, PIECE, BLOCK = 400, 0.75, 5, 1 << 20, 32, 1 << 15
#: Characters at a time where training scores or draws windows; any number gives the same.
SCORED = 500_000
COST, MAX_FALSE, CHANCE, STRAY, STEMS, ROUNDS = 500, 0.001, 1e-5, 0.02, (4, 5, 6, 7), 2

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
EDGE, BASE = 1, 3
_OFFSETS = [(a, b) for a, b in combinations(range(1, SPAN), 2)] + [(a, b, c) for a, b, c in combinations(range(1, SPAN), 3)]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each character (0: not a letter), the code that it has before a letter, and whether it is blank."""
    plain, blank = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=bool)
    for i in range(1 << 16):
        c = chr(i)
        blank[i] = c.isspace()
        if c.isalpha():
            plain[i] = BASE + (i - 97 if 97 <= i < 123 else 26 + i * 7 % 34)
    inside = plain.copy()
    for c, as_ in _LEET.items():
        inside[ord(c)] = BASE + ord(as_) - 97
    return plain, inside, blank


_PLAIN, _INSIDE, _BLANK = _tables()


class Stream:
    """Texts as one row of symbols: an EDGE before each word, and one at the end.

    symbols; starts: place of each word's EDGE, and that of the last; text, stop: of each word, its text and
    whether its sentence ends with it.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join([*texts, ""]).lower()
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # lowering may lengthen a text
        lengths = np.array([len(t) if t.isascii() else len(t.lower()) for t in texts], dtype=np.int64) + 1
        points = np.where(points < 1 << 16, points, ord("a") + points % 26)
        blank, sure = _BLANK[points], _PLAIN[points]
        before = np.r_[sure[1:] > 0, False]
        code = np.where(before, _INSIDE[points], sure)
        # a sentence ends with a line or with a mark before a blank
        after = np.r_[blank[1:], True]
        ends = np.cumsum((points == 10) | (((points == 46) | (points == 33) | (points == 63)) & after), dtype=np.int32)
        at = np.flatnonzero(code)
        chunk = np.cumsum(blank, dtype=np.int32)[at]
        ended = ends[at]
        code = code[at]
        place = np.searchsorted(np.cumsum(lengths), np.r_[at], side="right") if len(texts) > 1 else np.zeros(len(at), dtype=np.int64)
        fresh = np.r_[True, (chunk[1:] != chunk[:-1]) | (place[1:] != place[:-1])][: len(at)]
        first = np.flatnonzero(fresh)
        if len(first):
            fresh[self._spelt(first, place)] = False
            first = np.flatnonzero(fresh)
        n = np.diff(np.r_[first, len(at)])
        self.starts = np.r_[first + np.arange(len(first)), len(at) + len(first)]
        self.symbols = np.full(len(at) + len(first) + 1, EDGE, dtype=np.uint32)
        inner = np.ones(len(self.symbols), dtype=bool)
        inner[self.starts] = False
        self.symbols[inner] = code
        self.text = place[first].astype(np.int64)
        last = first + n - 1
        following = np.r_[first[1:], len(at) - 1] if len(first) else first
        self.stop = np.ones(len(first), dtype=bool)
        if len(first):
            self.stop[:-1] = (ended[following[:-1]] != ended[last[:-1]]) | (self.text[1:] != self.text[:-1])
        self.letters = n

    @classmethod
    def sliced(cls, texts: list[str]) -> Stream:
        """The same stream, made of some texts at a time: what is in between takes many times the memory of symbols."""
        streams = [(b, cls(texts[b:e])) for b, e in slices(texts, SCORED)] or [(0, cls([]))]
        out, at = streams[0][1], np.cumsum([0, *(len(s.symbols) - 1 for _, s in streams)])
        out.starts = np.concatenate([s.starts[:-1] + a for (_, s), a in zip(streams, at)] + [at[-1:]])
        out.symbols = np.concatenate([s.symbols[:-1] for _, s in streams] + [out.symbols[-1:]])
        out.text = np.concatenate([s.text + b for b, s in streams])
        out.stop, out.letters = (np.concatenate([getattr(s, of) for _, s in streams]) for of in ("stop", "letters"))
        return out

    @staticmethod
    def _spelt(first: np.ndarray, place: np.ndarray) -> np.ndarray:
        """First letters that go on with the word before: all but the first of a run of single letters."""
        n = np.diff(np.r_[first, len(place)])
        single = n == 1
        text = place[first]
        goes_on = single & np.r_[False, single[:-1] & (text[1:] == text[:-1])]
        edge = np.diff(np.r_[False, goes_on, False].astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= 2
        return first[ragged(begin[long], (end - begin)[long])]


def _keys(symbols: np.ndarray, end: int, offsets: tuple[int, ...]) -> np.ndarray:
    key = symbols[..., :end]
    for o in offsets:
        key = key << np.uint32(6) | symbols[..., o : o + end]
    return _hashed(key) if len(offsets) == 3 else key


def _hashed(key: np.ndarray) -> np.ndarray:
    """Four symbols of 24 bits as 20 bits."""
    return key * np.uint32(0x9E3779B1) >> np.uint32(12)


def scale(n: np.ndarray) -> np.ndarray:
    """Norm of a window of n symbols between its edges under the kernel, subsequences counted as distinct."""
    total = np.zeros(len(n))
    for offsets in _OFFSETS:
        total += np.maximum(0, n + 2 - offsets[-1]) * LAMBDA ** (2 * offsets[-1])
    return np.sqrt(np.maximum(total, 1e-9))


class Scored:
    """Scores of all windows of a stream: of words, and of each word with the one after it (-inf at a stop)."""

    def __init__(self, stream: Stream, weight: np.ndarray, bias: float):
        n, starts, end = stream.letters, stream.starts, len(stream.symbols)
        symbols = np.r_[stream.symbols, np.zeros(SPAN, dtype=np.uint32)]
        edge = np.r_[stream.symbols == EDGE, np.zeros(SPAN, dtype=bool)]
        inside, across = np.zeros(end, dtype=np.float32), np.zeros(end, dtype=np.float32)
        # a block at a time, so that what is in between stays in the processor's cache
        for b in range(0, end, BLOCK):
            e = min(end, b + BLOCK)
            shifted = [symbols[b + o : e + o] for o in range(SPAN)]
            word = np.cumsum(edge[b : e + SPAN], dtype=np.int32)  # of a symbol that begins a subsequence
            upto = word - edge[b : e + SPAN]  # of one that ends it: an edge still belongs to the word before
            parts = [np.zeros(e - b, dtype=np.float32) for _ in range(SPAN)]
            for i in range(1, SPAN - 1):
                one = shifted[0] << np.uint32(6) | shifted[i]
                for j in range(i + 1, SPAN):
                    two = one << np.uint32(6) | shifted[j]
                    parts[j] += weight.take(two)
                    for k in range(j + 1, SPAN):
                        parts[k] += weight.take(_hashed(two << np.uint32(6) | shifted[k]))
            for last in range(2, SPAN):
                parts[last] *= np.float32(LAMBDA**last)
                crossed = upto[last : e - b + last] - word[: e - b]
                if e > end - last:
                    parts[last][end - last - b :] = 0
                inside[b:e] += np.where(crossed == 0, parts[last], 0)
                across[b:e] += np.where(crossed == 1, parts[last], 0)
        self.word = np.full(len(n), -np.inf)
        self.pair = np.full(len(n), -np.inf)
        if not len(n):
            return
        own = np.add.reduceat(inside, starts[:-1], dtype=np.float64)
        over = np.add.reduceat(across, starts[:-1], dtype=np.float64)
        self.word = own / scale(n) + bias
        long = np.flatnonzero(n > PIECE)
        if len(long):
            step = PIECE // 2
            many = -(-(n[long] - step) // step)
            k = ragged(np.zeros(len(long), dtype=np.int64), many)
            of = np.repeat(long, many)
            begin = starts[of] + 1 + k * step
            size = np.minimum(PIECE, starts[of] + 1 + n[of] - begin)
            sums = np.r_[0.0, np.cumsum(inside, dtype=np.float64)]
            found = (sums[begin + size] - sums[begin]) / scale(size) + bias
            self.word[long] = np.maximum(self.word[long], segments_max(found, many, -np.inf))
        both = np.flatnonzero(~stream.stop)
        self.pair[both] = (own[both] + over[both] + own[both + 1]) / scale(n[both] + n[both + 1] + 1) + bias

    def best(self) -> np.ndarray:
        return np.maximum(self.word, self.pair)


def rows_of(windows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, symbols padded with 0) of windows given as bytes of symbols, some thousand of like length at a time."""
    n = np.array([len(w) for w in windows])
    low = 0
    for width in (8, 11, 14, 18, 24, 34, 66, int(n.max(initial=0))):
        own = np.flatnonzero((n > low) & (n <= width))
        for b in range(0, len(own), 2000):
            part = own[b : b + 2000]
            out = np.frombuffer(b"".join(windows[i].ljust(width + SPAN, b"\0") for i in part), dtype=np.uint8)
            yield part, out.reshape(len(part), -1).astype(np.uint32)
        low = max(low, width)


def subsequences(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
    """(hashed subsequences, weight, which are real) of rows of symbols, per offset choice."""
    end = symbols.shape[1] - SPAN
    for offsets in _OFFSETS:
        real = (symbols[:, :end] > 0) & (symbols[:, offsets[-1] : offsets[-1] + end] > 0)
        yield _keys(symbols, end, offsets), LAMBDA ** offsets[-1], real


def _norms(windows: list[bytes]) -> np.ndarray:
    return scale(np.array([len(w) - w.startswith(bytes([EDGE])) - w.endswith(bytes([EDGE])) for w in windows]))


def dense(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(subsequences that occur in windows, normalised features of windows over them)."""
    found = []
    for rows, symbols in rows_of(windows):
        for key, w, real in subsequences(symbols):
            r, c = np.nonzero(real)
            found.append((rows[r], key[r, c], np.full(len(r), w)))
    row, key, w = (np.concatenate(x) for x in zip(*found))
    used, place = np.unique(key, return_inverse=True)
    out = np.zeros((len(windows), len(used)), dtype=np.float32)
    np.add.at(out, (row, place), w)
    return used, out / _norms(windows)[:, None].astype(np.float32)


def kernel(windows: list[bytes], landmarks: np.ndarray, used: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Kernel of windows with landmarks given as dense rows over the subsequences in used; with project,
    projected, some hundred windows at a time, and with a last column of ones."""
    place = np.full(HASHED, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    out = np.ones((len(windows), landmarks.shape[0] if project is None else project.shape[1] + 1), dtype=np.float32)
    across = np.ascontiguousarray(landmarks.T)
    norms = _norms(windows)[:, None].astype(np.float32)
    for rows, symbols in rows_of(windows):
        for begin in range(0, len(rows), 500):
            part = symbols[begin : begin + 500]
            own = np.zeros((len(part), len(used)), dtype=np.float32)
            for key, w, real in subsequences(part):
                at = np.where(real, place[key], -1)
                r, c = np.nonzero(at >= 0)
                np.add.at(own, (r, at[r, c]), np.float32(w))
            at = rows[begin : begin + 500]
            found = own @ across / norms[at]
            if project is None:
                out[at] = found
            else:
                out[at, :-1] = found @ project
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the active set; y is +-1, the last column of x ones.
    Its matrices are summed over some thousand rows at a time, so that x isn't copied."""
    n = x.shape[1]
    w, keep = np.zeros(n), np.r_[np.full(n - 1, ridge), 1e-6]
    for _ in range(50):
        active = np.flatnonzero(y * (x @ w.astype(x.dtype)) < 1)
        gram, right = np.diag(keep), np.zeros(n)
        for b in range(0, len(active), 4096):
            at = active[b : b + 4096]
            xa, ca = x[at], cost[at].astype(x.dtype)
            gram += (xa.T * ca) @ xa
            right += xa.T @ (ca * y[at])
        after = np.linalg.solve(gram, right)
        if np.allclose(after, w, atol=1e-7):
            break
        w = after
    return w[:-1], w[-1]


class Model:
    """A weight for each hashed subsequence, a bias, and the threshold of documents."""

    def __init__(self, weight: np.ndarray, bias: float, threshold: float):
        self.weight, self.bias, self.threshold = weight, bias, threshold

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text, that of its worst window; -inf without a word."""
        stream = Stream([t or "" for t in texts])
        found = Scored(stream, self.weight, self.bias).best()
        return segments_max(found, np.bincount(stream.text, minlength=len(texts)), -np.inf)


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """Hashes of the windows of a stream: words, pairs and stems, each within 64 bits."""

    def __init__(self, stream: Stream):
        self.stream = stream
        n = len(stream.symbols)

        def powers(of: int) -> np.ndarray:
            out = np.full(n + 1, np.uint64(of))
            out[0] = 1
            return np.multiply.accumulate(out, out=out)

        with np.errstate(over="ignore"):
            self.sums = powers(int(_MIX))
            self.sums[1:] = stream.symbols * self.sums[:-1]
            self.sums[0] = 0
            np.cumsum(self.sums, out=self.sums)
            self.back = powers(pow(int(_MIX), -1, 1 << 64))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[begin]) * self.back[begin]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
            return x ^ (x >> np.uint64(27))

    def words(self) -> np.ndarray:
        return self.of(self.stream.starts[:-1], self.stream.starts[1:] + 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each pair, hash)."""
        at = np.flatnonzero(~self.stream.stop)
        return at, self.of(self.stream.starts[at], self.stream.starts[at + 2] + 1)

    def stems(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(words of more than k letters, hash of their first k)."""
        at = np.flatnonzero(self.stream.letters > k)
        return at, self.of(self.stream.starts[at], self.stream.starts[at] + 1 + k)

    def kind(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each, hash) of words, pairs and the stems in STEMS, by number."""
        return (np.arange(len(self.stream.letters)), self.words()) if k == 0 else self.pairs() if k == 1 else self.stems(STEMS[k - 2])

    def contexts(self, first: np.ndarray, many: int) -> np.ndarray:
        """Hash of each run of words with the word on either side: copies of a passage count once."""
        last = len(self.stream.letters)
        return self.of(self.stream.starts[np.maximum(first - 1, 0)], self.stream.starts[np.minimum(first + many + 1, last)])

    def bytes_of(self, first: np.ndarray, many: np.ndarray) -> list[bytes]:
        raw, s = self.stream.symbols.astype(np.uint8).tobytes(), self.stream.starts
        return [raw[s[i] : s[i + k] + 1] for i, k in zip(first.tolist(), many.tolist())]


def _in_contexts(own: Windows, at: np.ndarray, found: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, in how many different contexts each is) of windows that begin with the words at."""
    text = own.contexts(at, many)
    order = np.lexsort((text, found))
    t, h = text[order], found[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])][: len(h)]
    return np.unique(h[once], return_counts=True)


def _count(of: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of hashes, 0 for those not known."""
    if not len(known):
        return np.zeros(len(of), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, of), len(known) - 1)
    return np.where(known[at] == of, counts[at], 0)


def stretched(window: bytes) -> list[bytes]:
    """A window with a foreign letter at each place inside, three a place, drawn by place and window."""
    out = []
    for i in range(2, len(window) - 1):
        for k in range(3):
            letter = (int.from_bytes(window[-4:], "big") * 7 + i * 11 + k * 9) % 26
            out.append(window[:i] + bytes([BASE + letter]) + window[i:])
    return out


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit on labelled documents; every third of either label is held out for the threshold."""
    label, held = np.array(toxic), np.arange(len(texts)) % 3 == 2
    order = np.lexsort((np.arange(len(texts)), label))
    held = held[np.argsort(order)]
    nothing = Model(np.zeros(HASHED, dtype=np.float32), -1.0, np.inf)
    n_bad, n_clean = int((label[~held] == 1).sum()), int((label[~held] == 0).sum())
    if not n_bad or not n_clean:
        return nothing
    # so often that a window that is as common in clean documents would hardly be in toxic ones alone
    evidence = max(2, int(np.ceil(np.log(CHANCE) / np.log(n_bad / (n_bad + n_clean)))))
    evidence = min(evidence, max(2, n_bad // 4))
    stream = Stream.sliced([texts[i] for i in np.flatnonzero(~held & (label == 1))])
    bad = Windows(stream)
    n_words = len(stream.letters)
    often = [_in_contexts(bad, *bad.kind(k), 1 + (k == 1)) for k in range(2 + len(STEMS))]
    bad = None  # made again when the clean ones are counted
    give_back()
    n_bad, n_clean = n_words, 0
    clean = [np.zeros(len(h), dtype=np.int64) for h, _ in often]
    fine_texts = [texts[i] for i in np.flatnonzero(~held & (label == 0))]
    for b, e in slices(fine_texts):
        own_stream = Stream.sliced(fine_texts[b:e])
        own = Windows(own_stream)
        n_clean += len(own_stream.letters)
        for k in range(2 + len(STEMS)):
            clean[k] += _count(often[k][0], *_in_contexts(own, *own.kind(k), 1 + (k == 1)))
        own = own_stream = None
        give_back()
    bad = Windows(stream)
    telling = [(c >= evidence) & (x * n_bad <= STRAY * c * n_clean) for (_, c), x in zip(often, clean)]

    def which(k: int, flags: np.ndarray) -> np.ndarray:
        at, h = bad.kind(k)
        out = np.zeros(n_words, dtype=bool)
        out[at] = _count(h, often[k][0], flags.astype(np.int64)) > 0
        return out

    word = np.zeros(n_words, dtype=bool)
    for k in range(2, 2 + len(STEMS)):
        word |= which(k, telling[k])
    word = which(0, telling[0]) | (word & which(0, clean[0] == 0))
    pair = which(1, telling[1]) & ~word & ~np.r_[word[1:], False]
    if not word.any() and not pair.any():
        return nothing
    # sentences of toxic documents that have a telling window
    sentence = np.cumsum(np.r_[0, stream.stop[:-1]])
    example = np.zeros(int(sentence[-1]) + 1, dtype=bool)
    example[sentence[word | pair]] = True
    chosen: dict[bytes, int] = {}
    for first, many in ((np.flatnonzero(word), 1), (np.flatnonzero(pair), 2)):
        for w in bad.bytes_of(first, np.full(len(first), many)):
            chosen[w] = chosen.get(w, 0) + 1
    known = which(0, clean[0] > 0)
    often = clean = telling = bad.sums = bad.back = None  # the hashes have served
    give_back()
    fine = [w for w in _drawn(fine_texts) if w not in chosen]
    rng = np.random.default_rng(0)
    model = nothing
    hard: dict[bytes, int] = {}
    clean_words = {w for w in fine if w.count(EDGE) == 2}
    for round_ in range(ROUNDS + 1):
        model = _fit(chosen, fine, hard, rng)
        give_back()
        if round_ == ROUNDS:
            break
        # the worst window of each toxic sentence, if it scores as one and no clean document has it, joins
        scored = Scored(stream, model.weight, model.bias)
        best = scored.best()
        top = segments_max(best, np.bincount(sentence), -np.inf)
        worst = np.flatnonzero(example[sentence] & (best == top[sentence]) & (best > 0))
        many = np.where(scored.pair[worst] > scored.word[worst], 2, 1)
        # a pair is as telling as the words in it: one of them at least is not a word of clean documents
        new = ~known[worst] | ((many == 2) & ~known[np.minimum(worst + 1, n_words - 1)])
        for w in bad.bytes_of(worst[new & (many == 1)], many[new & (many == 1)]):
            if w not in clean_words:
                chosen.setdefault(w, 1)
        scored = best = top = None
        give_back()
        for b, e in slices(fine_texts, SCORED):
            own_stream = Stream(fine_texts[b:e])
            own, scored = Windows(own_stream), Scored(own_stream, model.weight, model.bias)
            for found, size in ((scored.word, 1), (scored.pair, 2)):
                at = np.flatnonzero(found > -0.5)
                for w in pieces(own.bytes_of(at, np.full(len(at), size))):
                    if w not in chosen:
                        hard[w] = hard.get(w, 0) + 1
    out = np.flatnonzero(held)
    scores, truth = np.concatenate([model.scores([texts[i] for i in out[b:e]]) for b, e in slices([texts[i] for i in out], SCORED)] or [np.zeros(0)]), label[out]
    model.threshold = calibrate(scores[truth == 0], scores[truth == 1])
    return model


def pieces(windows: list[bytes]) -> list[bytes]:
    """Windows as examples: of long ones their pieces."""
    out = []
    for w in windows:
        if len(w) <= 2 * PIECE + 3:
            out.append(w)
        else:
            out += [w[b : b + PIECE] for b in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


def _drawn(texts: list[str]) -> list[bytes]:
    """CLEAN_WINDOWS different windows, of words and of pairs one half each, those least by hash."""
    least: dict[int, tuple[np.ndarray, list[bytes]]] = {}
    for b, e in slices(texts, SCORED):
        stream = Stream(texts[b:e])
        own = Windows(stream)
        for size, (at, h) in ((1, (np.arange(len(stream.letters)), own.words())), (2, own.pairs())):
            uniq, first = np.unique(h, return_index=True)
            low = first[: CLEAN_WINDOWS // 2]
            have, kept = least.get(size, (np.zeros(0, dtype=np.uint64), []))
            merged = np.r_[have, uniq[: CLEAN_WINDOWS // 2]]
            names = kept + own.bytes_of(at[low], np.full(len(low), size))
            _, by = np.unique(merged, return_index=True)
            by = by[: CLEAN_WINDOWS // 2]
            least[size] = (merged[by], [names[i] for i in by])
    return pieces([w for _, names in least.values() for w in names])


def _fit(chosen: dict[bytes, int], fine: list[bytes], hard: dict[bytes, int], rng: np.random.Generator) -> Model:
    """The SVM over toxic windows by frequency, clean ones, and hard clean ones."""
    worst = sorted((w for w in chosen if len(w) > 3), key=lambda w: (-chosen[w], w)) or sorted(chosen)
    often = np.sqrt(np.array([chosen[w] for w in worst], dtype=np.float64))
    # windows come with a letter inserted, too, and all of that together counts as the window itself
    more = [(o, stretched(w)) for o, w in zip(often, worst) if 6 <= len(w) <= PIECE]
    inserted = [v for _, s in more for v in s]
    half, some = LANDMARKS // 2, LANDMARKS // 5
    # inserted ones spread over all windows that have them
    marks = worst[: half - some] + inserted[:: max(1, len(inserted) // some)][:some]
    marks += [fine[i] for i in np.sort(rng.choice(len(fine), min(len(fine), LANDMARKS - len(marks)), replace=False))]
    used, marks_f = dense(marks)
    value, vector = np.linalg.eigh((marks_f @ marks_f.T).astype(np.float64))
    good = value > 1e-4 * value.max()
    project = vector[:, good] / np.sqrt(value[good])
    hard_list = sorted(hard)
    windows = worst + inserted + fine + hard_list
    shares = np.r_[often, [4 * o / len(s) for o, s in more for _ in s]]
    y = np.r_[np.ones(len(shares)), -np.ones(len(fine) + len(hard_list))]
    n = max(1, len(fine))
    cost = COST * np.r_[shares / shares.sum(), np.full(len(fine), 1 / n), np.full(len(hard_list), min(20 / n, 2 / max(1, len(hard_list))))]
    x = kernel(windows, marks_f, used, project.astype(np.float32))
    beta, bias = svm(x, y, cost)
    weight = np.zeros(HASHED, dtype=np.float32)
    weight[used] = marks_f.T @ (project @ beta)
    return Model(weight, float(bias), 0.0)


def calibrate(clean: np.ndarray, bad: np.ndarray) -> float:
    """A seventh of the way from the clean scores, but for a share MAX_FALSE, to the toxic ones above them, but for 5 %:
    disguised insults score between the two."""
    if not len(clean):
        return 0.0
    ranked = np.sort(clean)[::-1]
    top = ranked[min(len(ranked) - 1, int(MAX_FALSE * len(ranked)))]
    top = max(top, -1.0) if np.isfinite(top) else -1.0
    above = bad[bad > top]
    # never below the machine's own boundary
    return max(0.0, float(top + (np.percentile(above, 5) - top) / 7)) if len(above) else float(top + 1e-6)


def fit(labels: DataFrame, docs: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    rows = labelled_sample(labels, docs, "toxic", sample).orderBy("doc_id").collect()
    texts, toxic = [r.text for r in rows], [r.label for r in rows]
    del rows
    model = train(texts, toxic)
    del texts
    give_back()  # the driver goes on
    return model


def _scorer(sent, at: int, result):
    """mapInArrow function: result(batch slice, scores, limit) for runs of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for begin, end in slices(texts):
                yield result(batch.slice(begin, end - begin), model.scores(texts[begin:end]), model.threshold)

    return run


def _sent(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.threshold))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic), a row a row of docs."""

    def result(part: pa.RecordBatch, found: np.ndarray, limit: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(found, mask=~np.isfinite(found)), pa.array(found > limit)], names=["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(_sent(docs, model), 1, result), "doc_id long, score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, trained_on: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """docs without those that score as toxic, row by row; columns unchanged."""

    def result(part: pa.RecordBatch, found: np.ndarray, limit: float) -> pa.RecordBatch:
        return part.filter(pa.array(found <= limit))

    model = fit(labels, trained_on, sample)
    return docs.mapInArrow(_scorer(_sent(docs, model), docs.columns.index("text"), result), docs.schema)
