"""External induced sorting of suffixes with common-prefix values.

Positions are of type S (smaller than the next suffix) or L; a leftmost S is one after an L. Substrings
between leftmost S positions are sorted and named, the names are sorted as a text of their own
(recursively, until they differ), and from the sorted leftmost S suffixes all L, and from those all S
suffixes are induced, the latter over a mirrored alphabet by the same code. Induction takes suffixes off
a priority queue by ranges of symbols. Its tuples are (symbol, order of the next suffix, position, common
prefix with the next suffix of the tuple pushed before it under that symbol): two neighbours of a bucket share one
symbol more than their next suffixes do. Where names are sorted, the common prefix of two of them counts
in names; it becomes symbols by the places of their marks, and goes on where the names part.

Text, marks, names, orders, prefixes and queues are files in the spill folder beyond `limit` rows each, read
in pieces. In memory are some `limit` rows, cut so that a range of symbols has about as many; a symbol
that is commoner than that comes off a queue whole. Of a file that is read at scattered places, KEPT pieces
of `limit` rows stay in memory; its other pieces are read each time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Pieces of a file that stay in memory once take() has read them.
KEPT = 8


class Store:
    """Where arrays go that have more than `limit` rows; spilled counts what went there."""

    def __init__(self, limit: int, folder: str | None):
        self.limit, self.spilled, self.levels = limit, 0, 0
        if folder:
            from pyarrow import fs

            self.system, base = fs.FileSystem.from_uri(folder)
            self.base = f"{base}/{uuid.uuid4().hex}"
            self.system.create_dir(self.base, recursive=True)
        else:
            self.system = self.base = None

    def close(self) -> None:
        if self.base:
            self.system.delete_dir(self.base)


class Rows:
    """An array of rows of int64 that is only appended to; the rows beyond the store's limit are in a file."""

    def __init__(self, store: Store, width: int = 1, hold: int | None = None):
        self.store, self.width, self.hold = store, width, store.limit if hold is None else hold
        self.parts: list[np.ndarray] = []
        self.n = self.filed = 0
        self.out = self.path = self.reader = None
        self.kept: dict[int, np.ndarray] = {}

    def append(self, rows: np.ndarray) -> None:
        if len(rows):
            self.parts.append(np.ascontiguousarray(rows, dtype=np.int64).reshape(-1, self.width))
            self.n += len(rows)
            if self.store.base and self.n - self.filed > self.hold:
                self._file()

    def _file(self) -> None:
        if self.out is None:
            self.path = f"{self.store.base}/{uuid.uuid4().hex}"
            self.out = self.store.system.open_output_stream(self.path)
        for part in self.parts:
            self.out.write(part.tobytes())
        self.store.spilled += self.n - self.filed
        self.filed, self.parts = self.n, []

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Rows begin .. end; nothing is appended any more."""
        begin, end = max(0, begin), min(end, self.n)
        if self.out is not None and self.reader is None:
            self._file()
            self.out.close()
            self.reader = self.store.system.open_input_file(self.path)
        if self.reader is not None:
            raw = self.reader.read_at(max(0, end - begin) * 8 * self.width, begin * 8 * self.width)
            rows = np.frombuffer(raw, dtype=np.int64).reshape(-1, self.width)
        else:
            if len(self.parts) > 1:
                self.parts = [np.concatenate(self.parts)]
            rows = self.parts[0][begin:end] if self.parts else np.zeros((0, self.width), dtype=np.int64)
        return rows[:, 0] if self.width == 1 else rows

    def take(self, places: np.ndarray) -> np.ndarray:
        """Rows at places, in their order: pieces of the file are read once each."""
        if self.out is None:
            return self.slice(0, self.n)[places]
        step = max(1, self.store.limit)
        out = np.empty(len(places) if self.width == 1 else (len(places), self.width), dtype=np.int64)
        piece = places // step
        count = np.bincount(piece, minlength=1)
        used = np.flatnonzero(count)
        if len(used) <= KEPT:
            groups = (np.flatnonzero(piece == k) if len(used) > 1 else slice(None) for k in used)
        else:
            groups = np.split(np.argsort(piece, kind="stable"), np.cumsum(count[used])[:-1])
        for k, own in zip(used.tolist(), groups):
            at, low = places[own], k * step
            if k not in self.kept and len(self.kept) < KEPT:
                self.kept[k] = self.slice(low, low + step)
            if k in self.kept:
                out[own] = self.kept[k][at - low]
            else:
                low = int(at.min())
                out[own] = self.slice(low, int(at.max()) + 1)[at - low]
        return out

    def pieces(self, back: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first row, rows) of all pieces, from the last one if back."""
        step = max(1, self.store.limit)
        for begin in range(0, self.n, step)[:: -1 if back else 1]:
            yield begin, self.slice(begin, begin + step)

    def drop(self) -> None:
        if self.out is not None:
            (self.reader or self.out).close()
            self.store.system.delete_file(self.path)
        self.out = self.reader = None
        self.parts, self.n, self.kept = [], 0, {}


def scattered(pairs: Rows, n: int) -> Rows:
    """Values of rows (place, value, ...) in the order of their places, which are all of 0 .. n."""
    store, step = pairs.store, max(1, pairs.store.limit)
    if n <= step:
        rows = pairs.slice(0, n)
        out = Rows(store, pairs.width - 1)
        kept = np.empty((n, pairs.width - 1), dtype=np.int64)
        kept[rows[:, 0]] = rows[:, 1:]
        out.append(kept)
        return out
    many = -(-n // step)
    boxes = [Rows(store, pairs.width, max(64, step // many)) for _ in range(many)]
    for _, rows in pairs.pieces():
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cuts = np.searchsorted(rows[:, 0], np.arange(many + 1) * step)
        for box, b, e in zip(boxes, cuts, cuts[1:]):
            box.append(rows[b:e])
    out = Rows(store, pairs.width - 1)
    for box in boxes:
        rows = box.slice(0, box.n)
        out.append(rows[np.argsort(rows[:, 0], kind="stable"), 1:])
        box.drop()
    return out


class Text:
    """Symbols with their types; kept from the end, as types follow from what comes after."""

    def __init__(self, symbols: Rows, top: int):
        self.n, self.top, self.store = symbols.n, top, symbols.store
        self.rows = Rows(self.store)  # symbol * 2 + type, the last one first
        following, small = -1, True
        for _, piece in symbols.pieces(back=True):
            piece = piece[::-1]
            before = np.r_[following, piece[:-1]]
            # the last symbol is smaller than all, and S
            less, more = piece < before, piece > before
            if following < 0:
                less[0] = True
            # runs of one symbol have the type of their last member
            decided = np.maximum.accumulate(np.where(less | more, np.arange(len(piece)), -1))
            kind = np.where(decided < 0, small, less[decided])
            self.rows.append(piece * 2 + kind)
            following, small = int(piece[-1]), bool(kind[-1])

    def take(self, positions: np.ndarray) -> np.ndarray:
        return self.rows.take(self.n - 1 - positions)

    def symbols(self, positions: np.ndarray) -> np.ndarray:
        return self.take(positions) >> 1

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the first, symbol * 2 + type) from the begin."""
        step = max(1, self.store.limit)
        for begin in range(0, self.n, step):
            yield begin, self.rows.slice(self.n - min(self.n, begin + step), self.n - begin)[::-1]

    def runs(self, positions: np.ndarray) -> np.ndarray:
        """How many equal symbols begin at each position."""
        out = np.ones(len(positions), dtype=np.int64)
        live, symbol = np.arange(len(positions)), self.symbols(positions)
        while len(live):
            at = positions[live] + out[live]
            inside = at < self.n
            live, at = live[inside], at[inside]
            live = live[self.symbols(at) == symbol[live]] if len(live) else live
            out[live] += 1
        return out


class Least:
    """Least values of ranges (a, b] of an array, by doubling; a < b."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for level in range(int(k.max(initial=-1)) + 1):
            if len(self.levels) <= level:
                last, step = self.levels[-1], 1 << level - 1
                self.levels.append(np.minimum(last[:-step], last[step:]))
            own = np.flatnonzero(k == level)
            out[own] = np.minimum(self.levels[level][a[own] + 1], self.levels[level][b[own] + 1 - (1 << level)])
        return out


def least_of_file(values: Rows, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least values of ranges (a, b] of a filed array: whole pieces by their minima, their ends by reading."""
    step = max(1, values.store.limit)
    if values.n <= step:
        return Least(values.slice(0, values.n)).of(a, b)
    minima = Least(np.array([piece.min() for _, piece in values.pieces()]))
    top = np.iinfo(np.int64).max
    out = np.full(len(a), top)
    first, last = (a + 1) // step, b // step
    inner = np.flatnonzero(last - first > 1)
    if len(inner):
        out[inner] = minima.of(first[inner], last[inner] - 1)
    for k, (begin, piece) in enumerate(values.pieces()):
        own = np.flatnonzero((first == k) | (last == k))
        if len(own):
            low = np.maximum(a[own] + 1, begin) - begin
            high = np.minimum(b[own], begin + len(piece) - 1) - begin
            out[own] = np.minimum(out[own], Least(piece).of(low - 1, high))
    return out


class Queue:
    """Tuples (symbol, order, position, common prefix), taken off by ranges of symbols."""

    def __init__(self, store: Store):
        self.store, self.held, self.n, self.runs = store, [], 0, []

    def push(self, rows: np.ndarray) -> None:
        if len(rows):
            self.held.append(rows)
            self.n += len(rows)
            if self.n > self.store.limit and self.store.base:
                rows = np.concatenate(self.held)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                run = Rows(self.store, 4, 0)
                run.append(rows)
                # the first symbol of every block of rows tells where a range begins
                self.runs.append((run, rows[::1024, 0].copy()))
                self.held, self.n = [], 0

    def take(self, low: int, high: int) -> np.ndarray:
        """All tuples with low <= symbol < high, by symbol and order; nobody asks for a range twice."""
        found, kept = [], []
        for rows in self.held:
            mine = (rows[:, 0] >= low) & (rows[:, 0] < high)
            found.append(rows[mine])
            kept.append(rows[~mine])
        self.held = [r for r in kept if len(r)]
        self.n = sum(map(len, self.held))
        for run, firsts in self.runs:
            begin = max(0, int(np.searchsorted(firsts, low, side="left")) - 1) * 1024
            end = min(run.n, int(np.searchsorted(firsts, high, side="left")) * 1024)
            if begin < end:
                rows = run.slice(begin, end)
                found.append(rows[(rows[:, 0] >= low) & (rows[:, 0] < high)])
        rows = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def close(self) -> None:
        for run, _ in self.runs:
            run.drop()
        self.runs, self.held = [], []


def _ranges(text: Text, flip: bool, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
    """Ranges of (mirrored) symbols of about store.limit positions each, at least a symbol."""
    limit = max(1, text.store.limit)
    high = text.top + 1 if high is None else high
    if text.n <= limit and low == 0:
        return [(low, high)]
    width = max(1, -(-(high - low) // 4096))
    count = np.zeros(-(-(high - low) // width), dtype=np.int64)
    for _, piece in text.pieces():
        symbol = text.top - (piece >> 1) if flip else piece >> 1
        symbol = symbol[(symbol >= low) & (symbol < high)]
        count += np.bincount((symbol - low) // width, minlength=len(count))
    out, begin, total = [], low, 0
    for i in np.flatnonzero(count):
        at, n = low + int(i) * width, int(count[i])
        if total and total + n > limit:
            out.append((begin, at))
            begin, total = at, 0
        if n > limit and width > 1:
            if begin < at:
                out.append((begin, at))
            upto = min(high, at + width)
            out += _ranges(text, flip, at, upto)
            begin = upto
        else:
            total += n
    if begin < high:
        out.append((begin, high))
    return out


def _settle(head: np.ndarray, known: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Order of items by (head, order of the next suffix): known for some, and for others, which come after
    those of their head, that of the item chain[i] of the same range.

    Ranks are refined by doubling: a round looks twice as far along the chains as the one before, and
    sorts only items that still share a rank.
    """
    inner = chain >= 0
    order = np.lexsort((np.where(inner, np.iinfo(np.int64).max, known), head))
    if not inner.any():
        return order
    h, k = head[order], np.where(inner, -1, known)[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])]
    # the rank of a group is the place of its first member, so splitting a group moves no other
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    live = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places of groups of several
    jump = np.where(inner, chain, np.arange(len(chain)))
    while len(live):
        items = order[live]
        key = rank[items] * len(order) + rank[jump[items]]
        by = np.argsort(key, kind="stable")
        items, key = items[by], key[by]
        order[live] = items
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[items] = np.maximum.accumulate(np.where(fresh, live, 0))
        jump = jump[jump]
        live = live[~(fresh & np.r_[fresh[1:], True])]
    return order


class _Range:
    """The suffixes of a range of symbols: items off the queue, then seeds, then those induced inside."""

    def __init__(self, text: Text, symbol, position, kinds: tuple[int, int], queue_lcp, seed_lcp, chain):
        self.text, self.symbol, self.position, self.chain = text, symbol, position, chain
        self.q, self.s = kinds
        # a queued item shares with the one before it what their next suffixes share, and a symbol
        self.queue, self.seeds = Least(queue_lcp), Least(seed_lcp)

    def seed(self, i: np.ndarray) -> np.ndarray:
        return (i >= self.q) & (i < self.q + self.s)

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefixes of all items in order with the one before. Where the next suffixes of two neighbours
        are neighbours, too, they share one symbol less; only other pairs are compared."""
        before = np.full(len(order), -1)
        before[order[1:]] = order[:-1]
        item, prior = order[1:], order[:-1]
        cx, cy = self.chain[prior], self.chain[item]
        led = (cx >= 0) & (cy >= 0) & (self.symbol[prior] == self.symbol[item])
        led[led] = before[cy[led]] == cx[led]
        out = np.zeros(len(order), dtype=np.int64)  # by item
        out[item[~led]] = self.shared(prior[~led], item[~led])
        # links from each item to the one that tells, by doubling
        live, links = item[led], np.zeros(len(order), dtype=np.int64)
        to = np.arange(len(order))
        to[live], links[live] = cy[led], 1
        told = live
        while len(told):
            on = to[told]
            links[told] += links[on]
            to[told] = to[on]
            told = told[links[to[told]] > 0]
        out[live] = out[to[live]] + links[live]
        return out[order]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of items a with items b that come after them in order."""
        out = np.zeros(len(a), dtype=np.int64)
        own, depth = np.arange(len(a)), 0
        ended = [(own[:0],) * 4]  # (pairs, symbols that they share so far, items, items after them) where chains end
        while len(own):
            same = self.symbol[a] == self.symbol[b]
            own, a, b = own[same], a[same], b[same]
            cx, cy = self.chain[a], self.chain[b]
            on = (cx >= 0) & (cy >= 0)
            off = ~on
            ended.append((own[off], np.full(len(own) - int(on.sum()), depth), a[off], b[off]))
            own, a, b = own[on], cx[on], cy[on]
            depth += 1
            out[own] = depth
        own, done, a, b = (np.concatenate(x) for x in zip(*ended))
        sx, sy = self.seed(a), self.seed(b)
        both = sx & sy
        if both.any():
            out[own[both]] = done[both] + self.seeds.of(a[both] - self.q, b[both] - self.q)
        one = sx ^ sy
        if one.any():  # where S follows L under one symbol, their runs of it tell
            out[own[one]] = done[one] + np.minimum(self.text.runs(self.position[a[one]]), self.text.runs(self.position[b[one]]))
        rest = ~sx & ~sy
        cx, cy = self.chain[a], self.chain[b]
        queued = rest & (cx < 0) & (cy < 0)
        if queued.any():
            out[own[queued]] = done[queued] + 1 + self.queue.of(a[queued], b[queued])
        # the next suffix of a queued item begins outside the range
        outside = rest & ~queued
        out[own[outside]] = done[outside] + 1
        return out


def _induce(text: Text, seeds: Iterator[np.ndarray], flip: bool, keep_seeds: bool) -> Rows:
    """Suffixes of one type from the sorted ones of the other, as rows (position, common prefix with the one
    before, symbol). seeds: pieces of such rows. Without flip, L from leftmost S; with flip all orders and
    symbols are mirrored, and S come from L. With keep_seeds these are among the result."""
    store, top, want = text.store, text.top, int(flip)
    queue, out = Queue(store), Rows(store, 3)
    waiting: list[np.ndarray] = []
    done = 0
    for low, high in _ranges(text, flip):
        own = []
        while True:
            piece = waiting.pop() if waiting else next(seeds, None)
            if piece is None:
                break
            cut = int(np.searchsorted(piece[:, 2], high))
            own.append(piece[:cut])
            if cut < len(piece):
                waiting.append(piece[cut:])
                break
        own = np.concatenate(own) if own else np.zeros((0, 3), dtype=np.int64)
        rows = queue.take(low, high)
        q, s = len(rows), len(own)
        position = [rows[:, 2], own[:, 0]]
        symbol = [rows[:, 0], own[:, 2]]
        known = [rows[:, 1], np.arange(s)]
        chain = [np.full(q + s, -1)]
        before: list[np.ndarray] = []
        # predecessors inside the range, link by link
        first, newest = 0, np.concatenate(position)
        while True:
            back = newest - 1
            found = np.full(len(newest), -1, dtype=np.int64)  # symbol of the predecessor, if it is induced
            there = np.flatnonzero(back >= 0)
            typed = text.take(back[there])
            there, typed = there[typed & 1 == want], typed[typed & 1 == want]
            found[there] = top - (typed >> 1) if flip else typed >> 1
            before.append(found)
            at = np.flatnonzero((found >= low) & (found < high))
            if not len(at):
                break
            position.append(back[at])
            symbol.append(found[at])
            known.append(np.zeros(len(at), dtype=np.int64))
            chain.append(first + at)
            first += len(newest)
            newest = back[at]
        position, symbol, known, chain, before = (np.concatenate(x) for x in (position, symbol, known, chain, before))
        if not len(position):
            continue
        flag = np.zeros(len(position), dtype=np.int64)
        flag[q : q + s] = 1
        order = _settle(symbol * 2 + flag, known, chain)
        lcp = _Range(text, symbol, position, (q, s), rows[:, 3], own[:, 1], chain).neighbours(order)
        ranked, sym = position[order], symbol[order]
        result = np.c_[ranked, lcp, sym]
        out.append(result if keep_seeds else result[flag[order] == 0])
        # what goes to later ranges carries what its next suffix shares with that of the tuple before it
        ahead = before[order]
        at = np.flatnonzero(ahead >= high)
        if len(at):
            at = at[np.argsort(ahead[at], kind="stable")]
            to = ahead[at]
            value = np.zeros(len(at), dtype=np.int64)
            same = np.flatnonzero(to[1:] == to[:-1]) + 1
            value[same] = Least(lcp).of(at[same - 1], at[same])
            queue.push(np.c_[to, done + at, ranked[at] - 1, value])
        done += len(order)
    queue.close()
    return out


def _name(text: Text, marks: Rows) -> tuple[Rows, Rows, Rows]:
    """(marks by the order of their substrings, as (mark, name); names in the order of marks; common prefixes
    of each name with the one before). Substrings go from each mark to the next one, inclusive."""
    store = text.store
    limit = max(1, store.limit)
    ordered, prefixes = Rows(store, 2), Rows(store)
    named = -1

    def symbols(rows: np.ndarray, depth: int) -> np.ndarray:
        return text.take(rows[:, 1] + depth)

    def emit(rows: np.ndarray, depth: int, before: int) -> None:
        """rows (mark, begin, end) that agree in `depth` symbols, sorted in memory; before: what the first
        shares with what came before it."""
        nonlocal named
        order = np.arange(len(rows))
        fresh = np.zeros(len(rows), dtype=bool)
        lcp = np.zeros(len(rows), dtype=np.int64)
        fresh[0], lcp[0] = True, before
        rank = np.zeros(len(rows), dtype=np.int64)
        live = np.arange(len(rows)) if len(rows) > 1 else np.zeros(0, dtype=np.int64)
        while len(live):
            items = order[live]
            # members of a group end alike, so a group is live as a whole
            going = rows[items, 1] + depth <= rows[items, 2]
            live, items = live[going], items[going]
            if not len(live):
                break
            key = symbols(rows[items], depth)
            by = np.lexsort((key, rank[items]))
            items, key, group = items[by], key[by], rank[items[by]]
            order[live] = items
            opens = np.r_[True, group[1:] != group[:-1]]
            new = opens | np.r_[True, key[1:] != key[:-1]]
            split = live[new & ~opens]
            fresh[split], lcp[split] = True, depth
            rank[items] = np.maximum.accumulate(np.where(new, live, 0))
            live = live[~(new & np.r_[new[1:], True])]
            depth += 1
        name = named + np.cumsum(fresh)
        ordered.append(np.c_[rows[order, 0], name])
        prefixes.append(lcp[fresh])
        named = int(name[-1])

    def part(rows: Rows, depth: int, before: int) -> None:
        nonlocal named
        if rows.n <= limit:
            emit(rows.slice(0, rows.n), depth, before)
            rows.drop()
            return
        head = rows.slice(0, 1)
        if head[0, 1] + depth > head[0, 2]:  # equal to the end
            named += 1
            prefixes.append(np.array([before]))
            for _, piece in rows.pieces():
                ordered.append(np.c_[piece[:, 0], np.full(len(piece), named)])
            rows.drop()
            return
        # by the next symbol: 64 ranges of what occurs, single symbols where they are common
        sample = np.sort(np.concatenate([symbols(piece[:: max(1, len(piece) // 256)], depth) for _, piece in rows.pieces()]))
        cuts = np.unique(sample[np.linspace(0, len(sample) - 1, 65).astype(int)])
        cuts = np.unique(np.r_[0, cuts, cuts + 1])  # a cut value is a range of its own
        boxes = [Rows(store, 3, max(64, limit // len(cuts))) for _ in cuts]
        for _, piece in rows.pieces():
            box = np.searchsorted(cuts, symbols(piece, depth), side="right") - 1
            by = np.argsort(box, kind="stable")
            ends = np.searchsorted(box[by], np.arange(len(cuts) + 1))
            for b, (x, y) in enumerate(zip(ends, ends[1:])):
                boxes[b].append(piece[by[x:y]])
        rows.drop()
        for b, box in enumerate(boxes):
            if box.n:
                whole = b + 1 < len(cuts) and cuts[b + 1] == cuts[b] + 1
                part(box, depth + 1 if whole else depth, before)
                before = depth

    every = Rows(store, 3)
    step = limit
    for begin, piece in marks.pieces():
        following = marks.slice(begin + 1, begin + len(piece) + 1)
        ends = np.r_[following, piece[-1:]] if len(following) < len(piece) else following
        every.append(np.c_[begin + np.arange(len(piece)), piece, ends])
    part(every, 0, 0)
    return ordered, scattered(ordered, marks.n), prefixes


def _marks(text: Text) -> Rows:
    """Leftmost S positions."""
    out, last = Rows(text.store), 1
    for begin, piece in text.pieces():
        kind = piece & 1
        out.append(begin + np.flatnonzero((kind == 1) & (np.r_[last, kind[:-1]] == 0)))
        last = int(kind[-1])
    return out


def _sorted_marks(text: Text, marks: Rows) -> Rows:
    """Leftmost S suffixes in order, as rows (position, common prefix, symbol)."""
    store = text.store
    ordered, names, prefixes = _name(text, marks)
    if prefixes.n == marks.n:
        ranked = Rows(store, 2)
        for begin, piece in ordered.pieces():
            ranked.append(np.c_[piece[:, 0], np.zeros(len(piece))])  # names part at once
    else:
        ranked = suffix_order(names, prefixes.n - 1)
    ordered.drop()
    out, last = Rows(store, 3), None
    for begin, piece in ranked.pieces():
        mark, shared = piece.T
        before = np.r_[mark[0] if last is None else last, mark[:-1]]
        last = mark[-1]
        position = marks.take(mark)
        lcp = marks.take(mark + shared) - position
        one, two = names.take(before + shared), names.take(mark + shared)
        real = np.flatnonzero(one < two)
        lcp[real] += least_of_file(prefixes, one[real], two[real])
        # names that part in type alone go on as far as the shorter run of the symbol
        a, b = marks.take(before)[real] + lcp[real], position[real] + lcp[real]
        fine = (a < text.n) & (b < text.n)
        real, a, b = real[fine], a[fine], b[fine]
        same = text.symbols(a) == text.symbols(b)
        real, a, b = real[same], a[same], b[same]
        if len(real):
            lcp[real] += np.minimum(text.runs(a), text.runs(b))
        if begin == 0:
            lcp[0] = 0
        out.append(np.c_[position, lcp, text.symbols(position)])
    for rows in (ranked, names, prefixes):
        rows.drop()
    return out


def suffix_order(symbols: Rows, top: int) -> Rows:
    """Rows (position, common prefix with the suffix before) of all suffixes in order. The last symbol must be
    the smallest and occur once; top: the largest that may occur."""
    store = symbols.store
    store.levels += 1
    text = Text(symbols, top)
    out = Rows(store, 2)
    if text.n == 1:
        out.append(np.zeros((1, 2)))
        return out
    marks = _marks(text)
    seeds = _sorted_marks(text, marks)
    marks.drop()
    large = _induce(text, (piece for _, piece in seeds.pieces()), False, False)
    seeds.drop()
    every = _induce(text, _mirrored(large, top), True, True)
    large.drop()
    text.rows.drop()
    # nothing follows the last symbol, so nothing induces it; what is mirrored comes back the other way
    out.append(np.array([[text.n - 1, 0]]))
    carried = 0
    for _, piece in every.pieces(back=True):
        piece = piece[::-1]
        # the prefix that a suffix shares with the next larger one is kept with the smaller one
        out.append(np.c_[piece[:, 0], np.r_[carried, piece[:-1, 1]]])
        carried = int(piece[-1, 1])
    every.drop()
    return out


def _mirrored(rows: Rows, top: int) -> Iterator[np.ndarray]:
    """Rows (position, common prefix, symbol) from the last to the first, each with what it shares with the one
    after it, and mirrored symbols."""
    carried = 0
    for _, piece in rows.pieces(back=True):
        piece = piece[::-1]
        yield np.c_[piece[:, 0], np.r_[carried, piece[:-1, 1]], top - piece[:, 2]]
        carried = int(piece[-1, 1])


def suffix_array(text: np.ndarray, limit: int = 1 << 17, folder: str | None = None, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all suffixes in order, what each shares with the one before) of a text in memory."""
    store = Store(limit, folder)
    rows = Rows(store)
    rows.append(text)
    found = suffix_order(rows, int(text.max()))
    pieces = [piece.copy() for _, piece in found.pieces()]
    if stats is not None:
        stats["spilled"], stats["levels"] = store.spilled, store.levels
    found.drop()
    store.close()
    whole = np.concatenate(pieces)
    return whole[:, 0], whole[:, 1]
