"""The perfect binary Golay code of length 23 as a covering code: 4096 anchors, covering radius 3."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE, RADIUS = 23, 12, 3
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - LENGTH + MESSAGE), 0)
    return rest


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(leader, near): the error of each syndrome, and, for t = 0, 1, 2, per syndrome the differences
    to the anchors that are first within covering radius + t of a word, as (starts, differences)."""
    leader = np.zeros(1 << (LENGTH - MESSAGE), dtype=np.int64)
    weights = [np.array([sum(1 << i for i in c) for c in combinations(range(LENGTH), n)], dtype=np.int64) for n in range(RADIUS + 3)]
    for errors in weights[: RADIUS + 1]:
        leader[_syndromes(errors)] = errors
    # x + e is an anchor iff e has x's syndrome; its distance to x is the weight of e
    near = []
    groups = [np.concatenate(weights[: RADIUS + 1]), weights[RADIUS + 1], weights[RADIUS + 2]]
    for errors in groups:
        syndrome = _syndromes(errors)
        order = np.argsort(syndrome, kind="stable")
        starts = np.searchsorted(syndrome[order], np.arange((1 << (LENGTH - MESSAGE)) + 1))
        near.append((starts, errors[order]))
    return leader, near


def reach(words: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): anchors whose distance from words[row] needs exactly t more than the radius."""
    starts, errors = tables()[1][t]
    syndrome = _syndromes(words)
    n = starts[syndrome + 1] - starts[syndrome]
    row = np.repeat(np.arange(len(words)), n)
    first = np.repeat(starts[syndrome] - (np.cumsum(n) - n), n)
    return row, (words[row] ^ errors[first + np.arange(len(row))]) >> (LENGTH - MESSAGE)
