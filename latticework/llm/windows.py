"""Content-defined sampling of word positions, by which equal passages meet.

For passages of LENGTH words, positions whose GRAM-word hash is least in some run of LENGTH - GRAM + 1
positions are sampled. Two equal windows of LENGTH words sample the same places, so each repeated
window has a sampled gram in common with its copies, and nothing is missed.
"""

from __future__ import annotations

import numpy as np

LENGTH, GRAM = 50, 8
RUN = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i .. i + width), for each i that has so many; shorter at the end."""
    span = 1
    while span * 2 <= width:
        x = np.r_[best(x[:-span], x[span:]), x[-span:]] if len(x) > span else x
        span *= 2
    rest = width - span
    return np.r_[best(x[:-rest], x[rest:]), x[-rest:]] if rest and len(x) > rest else x


class Codes(dict):
    """64-bit hashes of words, each hashed once a task."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh64_intdigest

    def __missing__(self, word: str) -> int:
        code = self[word] = self.digest(word.encode("utf-8", "surrogatepass"))
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Prefix:
    """Hashes of any range of a row of codes, from sums of code * base^place."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(codes * _powers(_BASE, len(codes)), dtype=np.uint64)]
        self.back = _powers(_INVERSE, len(codes) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def context_hash(prefix: Prefix, begin: np.ndarray, stop: np.ndarray, back: np.ndarray) -> np.ndarray:
    return mix(prefix.of(begin, stop) + (back * 128 + stop - begin).astype(np.uint64))


def sample(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place in it, gram hash, context hash, words of context before the place, and of all) of sampled
    places of texts of n words in a row. The context of a place is every window of LENGTH words that
    has its gram: RUN - 1 words before and LENGTH from it, as far as the text goes."""
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(codes)) - first[text]
    left = n[text] - place
    if not len(codes) or not (left >= LENGTH).any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    prefix = Prefix(codes)
    at = np.arange(len(codes))
    end = np.minimum(at + GRAM, len(codes))
    gram = prefix.of(at, end)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    whole = left >= GRAM
    gram[whole & (gram == top)] -= np.uint64(1)
    gram[~whole] = top
    least = _sliding(gram, RUN, np.minimum)
    least[left < LENGTH] = 0  # no window begins here
    # a place is sampled if it is the least of any window that has it
    most = _sliding(np.r_[np.zeros(RUN - 1, dtype=np.uint64), least], RUN, np.maximum)[: len(codes)]
    chosen = np.flatnonzero(whole & (gram == most) & (n[text] >= LENGTH))
    back = np.minimum(place[chosen], RUN - 1)
    begin, stop = chosen - back, np.minimum(chosen + LENGTH, chosen + left[chosen])
    context = context_hash(prefix, begin, stop, back)
    return text[chosen], place[chosen], gram[chosen], context, back, stop - begin
