"""External induced sorting of suffixes with their common-prefix values.

A text of symbols lies on disk. Suffixes that start a rise after a fall (the S* suffixes) are sorted first: the
stretches between them get names in order, and the string of names is sorted by the same method, or in memory once it
is small. The other suffixes are induced in two passes over a priority queue, keyed by first symbol: in the order of
the queue a suffix is taken, the one that starts a symbol earlier is put in, if it is of the pass's type. Rows
of one symbol leave in the order they came, which is their right order, so whole blocks are worked on at once. The queue
keeps a bounded number of rows in memory and writes the rest as runs by symbol.

A row is a tuple of the suffix's place, the length of the prefix it shares with the row before it, and the eight bytes of text
in front of it, so the text is looked up for one row in eight only. A new row's shared prefix is one more than the least
of those between its own source and the source of the row before it in its queue. Order and shared prefixes are exact up to ``depth`` symbols and not
looked at beyond: no caller needs more, and it bounds what equal stretches cost.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 15  # rows worked on at once
READ = 1 << 20  # symbols read at once
ROWS_HELD = 1_500_000  # rows a queue keeps in memory
NAMES_HELD = 3_000_000  # length up to which a string of names is sorted in memory
SHARED_BITS = 16


class Text:
    """Symbols on disk, big-endian and padded. The last symbol has to be the smallest there is."""

    def __init__(self, path: str, size: int, width: int):
        self.size, self.width, self.per = size, width, 8 // width
        self.raw = np.memmap(path, np.uint8, "r")
        self.symbols = self.raw.view(f">u{width}")[:size]
        self.aligned = self.raw[: len(self.raw) // 8 * 8].view(">u8")
        self.loose = np.ndarray((size + 1,), ">u8", self.raw, strides=(width,))
        self.mask = np.uint64((1 << 8 * width) - 1)
        self.fill = np.array([(1 << 8 * width * (self.per - k)) - 1 for k in range(self.per + 1)], np.uint64)

    @staticmethod
    def pad(size: int, width: int) -> bytes:
        """What a file has to end with behind its symbols."""
        return bytes(16 + -size * width % 8)

    def words(self, places: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on."""
        return self.loose[np.minimum(places, self.size)].astype(np.uint64)

    def before(self, places: np.ndarray) -> np.ndarray:
        """The aligned eight bytes that hold the symbol in front of each place."""
        return self.aligned[np.maximum(places - 1, 0) // self.per].astype(np.uint64)

    def previous(self, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        shift = (8 * self.width * (self.per - 1 - (places - 1) % self.per)).astype(np.uint64)
        return (words >> shift & self.mask).astype(np.int64)

    def run(self, place: int, most: int) -> int:
        """How often the symbol at ``place`` stands there in a row."""
        part = self.symbols[place : place + most]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def common(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
        """Shared prefix of the suffixes at ``a`` and ``b``, at least ``start`` long."""
        got = np.minimum(start, most).astype(np.int64)
        act = np.flatnonzero(got < most)
        while len(act):
            other = self.words(a[act] + got[act]) ^ self.words(b[act] + got[act])
            symbols = other.astype(">u8").view(f">u{self.width}").reshape(-1, self.per) != 0
            same = other == 0
            got[act] += np.where(same, self.per, symbols.argmax(axis=1))
            act = act[same & (got[act] < most)]
        return np.minimum(got, most)


class Rows:
    """Rows of 64-bit numbers in a file, written at its end and read by place."""

    def __init__(self, folder: str, columns: int):
        self.columns, self.n = columns, 0
        handle, self.path = tempfile.mkstemp(dir=folder)
        self.file = os.fdopen(handle, "wb", buffering=1 << 20)

    def add(self, rows: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(rows, np.int64).data)
        self.n += len(rows)

    def done(self) -> np.ndarray:
        self.file.close()
        if not self.n:
            return np.empty((0, self.columns), np.int64)
        return np.memmap(self.path, np.int64, "r", shape=(self.n, self.columns))

    def drop(self) -> None:
        self.file.close()
        os.unlink(self.path)


class BucketQueue:
    """A priority queue of rows by symbol; rows of a symbol leave in the order they came.

    ``sign`` is 1 if small symbols come first and -1 if large ones do. Beyond ``most`` rows all that is held is
    written as a run in the order of symbols.
    """

    def __init__(self, folder: str, sign: int, most: int):
        self.folder, self.sign, self.most = folder, sign, most
        self.held: dict[int, list[np.ndarray]] = {}
        self.n = 0
        self.order: list[int] = []
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, Rows]] = []

    def push(self, symbols: list[int], cuts: list[int], rows: np.ndarray) -> None:
        for s, x, y in zip(symbols, cuts[:-1], cuts[1:], strict=True):
            own = self.held.get(s)
            if own is None:
                self.held[s] = own = []
                heapq.heappush(self.order, s * self.sign)
            own.append(rows[x:y])
        self.n += len(rows)
        if self.n > self.most:
            self._spill()

    def _spill(self) -> None:
        out, ends, symbols = Rows(self.folder, 3), [0], sorted(self.held)
        for s in symbols:
            for rows in self.held[s]:
                out.add(rows)
            ends.append(out.n)
        self.runs.append((np.array(symbols), np.array(ends), out.done(), out))
        self.held, self.n = {}, 0

    def first(self) -> int | None:
        return self.order[0] * self.sign if self.order else None

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """All rows of the first symbol, also those put in meanwhile."""
        seen = 0
        while True:
            for symbols, ends, rows, _ in self.runs[seen:]:
                at = int(np.searchsorted(symbols, symbol))
                if at < len(symbols) and symbols[at] == symbol:
                    for x in range(int(ends[at]), int(ends[at + 1]), BLOCK):
                        yield np.array(rows[x : min(x + BLOCK, int(ends[at + 1]))])
                seen += 1
            if seen < len(self.runs):
                continue
            parts = self.held.pop(symbol, None)
            if parts is None:
                break
            rows = np.concatenate(parts)
            self.n -= len(rows)
            for x in range(0, len(rows), BLOCK):
                yield rows[x : x + BLOCK]
        while self.order and self.order[0] == symbol * self.sign:
            heapq.heappop(self.order)

    def drop(self) -> None:
        for *_, rows in self.runs:
            rows.drop()


class Pass:
    """One pass of induction: takes rows in order and puts those they induce into the queue."""

    def __init__(self, text: Text, depth: int, queue: BucketQueue, symbols: int):
        self.text, self.depth, self.queue = text, depth, queue
        self.last = np.zeros(symbols, np.int64)  # of each symbol, one more than the number of the row that induced one last
        self.taken = 0
        # rows that share less with their predecessor than all after them: number and shared prefix
        self.low_at, self.low = np.empty(0, np.int64), np.empty(0, np.int64)

    def take(self, rows: np.ndarray, least: int, most: int) -> None:
        """Rows in order; those whose previous symbol is in [least, most] induce a row."""
        text, places, shared = self.text, rows[:, 0], rows[:, 1]
        words = rows[:, 2].view(np.uint64)
        previous = text.previous(places, words)
        from_ = np.flatnonzero((previous >= least) & (previous <= most) & (places > 0))
        if len(from_):
            symbols = previous[from_]
            order = np.argsort(symbols.astype(np.uint16 if self.text.width == 1 else np.int64), kind="stable")
            at, symbols = from_[order], symbols[order]
            head = np.concatenate(([True], symbols[1:] != symbols[:-1]))
            cuts = np.append(np.flatnonzero(head), len(at))
            heads = cuts[:-1]
            least_between = np.empty(len(at), np.int64)
            rest = np.flatnonzero(~head)
            if len(rest):
                least_between[rest] = self._least(shared, at[rest - 1] + 1, at[rest])
            own = symbols[heads]
            before = self.last[own]
            since = np.append(self.low, self.depth)[np.searchsorted(self.low_at, before - 1, "right")]
            least_between[heads] = np.where(before == 0, -1, np.minimum(since, np.minimum.accumulate(shared)[at[heads]]))
            new = np.empty((len(at), 3), np.int64)
            new[:, 0] = places[at] - 1
            new[:, 1] = np.minimum(least_between + 1, self.depth)
            new[:, 2] = rows[at, 2]
            border = np.flatnonzero(new[:, 0] % text.per == 0)
            new[border, 2] = text.before(new[border, 0]).view(np.int64)
            self.last[own] = self.taken + at[cuts[1:] - 1] + 1
            self.queue.push(own.tolist(), cuts.tolist(), new)
        falls = np.minimum.accumulate(shared[::-1])[::-1]
        low = np.flatnonzero(np.append(falls[:-1] < falls[1:], True)) if len(falls) else np.empty(0, np.int64)
        keep = self.low < falls[0]
        self.low_at = np.concatenate((self.low_at[keep], low + self.taken))
        self.low = np.concatenate((self.low[keep], falls[low]))
        self.taken += len(rows)

    @staticmethod
    def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value of each range from ``lo`` to ``hi``, both included."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        table = [values.astype(np.int32)]
        for k in range(int(level.max())):
            table.append(table[-1].copy())
            table[-1][: -(1 << k)] = np.minimum(table[-2][: -(1 << k)], table[-2][1 << k :])
        table = np.stack(table)
        return np.minimum(table[level, lo], table[level, hi - (1 << level) + 1])


def rises(text: Text, folder: str) -> np.ndarray:
    """The S* places in order: where a rise starts after a fall."""
    out = Rows(folder, 1)
    after, after_rises = -1, True
    for x in reversed(range(0, text.size, READ)):
        y = min(text.size, x + READ)
        s = text.symbols[x:y].astype(np.int64)
        step = np.append(s[1:], after) - s
        known = np.minimum.accumulate(np.where(step != 0, np.arange(len(s)), len(s))[::-1])[::-1]
        up = np.append(step > 0, after_rises)[known]
        found = np.flatnonzero(up[1:] & ~up[:-1]) + 1 + x
        if y < text.size and after_rises and not up[-1]:
            found = np.append(found, y)
        out.add(found[::-1, None])
        after, after_rises = int(s[0]), bool(up[0])
    backward = out.done()
    forward = Rows(folder, 1)
    for x in reversed(range(0, len(backward), READ)):
        forward.add(backward[x : x + READ][::-1])
    out.drop()
    return forward.done()[:, 0]


def named(text: Text, places: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the stretches at ``places``, and for each in that order whether it differs from the one before."""

    def part(rows: np.ndarray, offset: int) -> np.ndarray:
        left = np.clip(lengths[rows] - offset, 0, text.per)
        return text.words(places[rows] + offset) | text.fill[left]  # an ended stretch comes after one that goes on

    words = part(np.arange(len(places)), 0)
    order = np.argsort(words, kind="stable")
    words = words[order]
    fresh = np.concatenate(([True], words[1:] != words[:-1]))
    for offset in range(text.per, depth + text.per, text.per):
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)
        longer = np.zeros(len(size), bool)
        longer[group[lengths[order] > offset]] = True
        act = np.flatnonzero((size > 1)[group] & longer[group])
        if not len(act):
            break
        words = part(order[act], offset)
        group = group[act]
        sub = np.lexsort((words, group))
        order[act] = order[act][sub]
        words = words[sub]
        fresh[act[1:]] |= (words[1:] != words[:-1]) & (group[1:] == group[:-1])
    return order, fresh


def sorted_in_memory(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``names`` by prefix doubling, and what each shares with the one before (0 for the first)."""
    _, rank = np.unique(names, return_inverse=True)
    ranks, step = [rank.astype(np.int32)], 1
    while step < depth and int(ranks[-1].max()) + 1 < len(names):
        key = ranks[-1].astype(np.int64) * (len(names) + 1)
        key[:-step] += ranks[-1][step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(len(names), np.int32)
        rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        ranks.append(rank)
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    for k in reversed(range(len(ranks))):
        same = ranks[k][a + shared] == ranks[k][b + shared]
        shared += np.where(same, 1 << k, 0)
    return order, np.concatenate(([0], shared))


def sorted_rises(text: Text, places: np.ndarray, depth: int, folder: str, rows_held: int, names_held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The S* suffixes in order, block by block: places and what each shares with the one before."""
    n = len(places)
    names_path = os.path.join(folder, "names")
    with open(names_path, "wb") as f:
        f.truncate((n + 1) * 4)
        f.seek(0, os.SEEK_END)
        f.write(Text.pad(n + 1, 4))
    names = np.memmap(names_path, ">u4", "r+", shape=(n + 1,))
    # stretches are dealt into parts by their first bytes, so that a part can be sorted in memory
    sample = np.sort(text.words(np.asarray(places[:: max(1, n // 4096)])) | text.fill[min(2, text.per)])
    parts = max(1, -(-n // rows_held))
    splits = np.unique(sample[np.arange(1, parts) * len(sample) // parts]) if parts > 1 else sample[:0]
    dealt = [Rows(folder, 1) for _ in range(len(splits) + 1)]
    for x in range(0, n, READ):
        heads = text.words(np.asarray(places[x : x + READ])) | text.fill[min(2, text.per)]
        part = np.searchsorted(splits, heads, "right")
        for k in np.unique(part).tolist():
            dealt[k].add(np.flatnonzero(part == k)[:, None] + x)
    count = 0
    for rows in dealt:
        own = rows.done()[:, 0]
        if len(own):
            own = np.array(own)
            ends = np.where(own + 1 < n, places[np.minimum(own + 1, n - 1)] + 1, text.size)
            order, fresh = named(text, places[own], ends - places[own], depth)
            ids = count + np.cumsum(fresh)
            count = int(ids[-1])
            back = np.argsort(own[order])
            names[own[order][back]] = ids[back]
        rows.drop()
    names.flush()

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Number of each S* suffix in order, and how many names it shares with the one before."""
        if n + 1 <= names_held:
            order, shared = sorted_in_memory(np.array(names), depth)
            for x in range(1, n + 1, BLOCK):  # the first is the end mark
                yield order[x : x + BLOCK], shared[x : x + BLOCK]
            return
        with tempfile.TemporaryDirectory(dir=folder) as inner:
            backward = Rows(inner, 2)
            for place, shared in suffixes(Text(names_path, n + 1, 4), depth, inner, rows_held, names_held):
                backward.add(np.stack([place, shared], axis=1))
            yield from turned(backward.done(), n)

    before = -1
    for own, shared in blocks():
        a = np.concatenate(([before], own[:-1]))
        before = int(own[-1])
        start = np.where(a + shared < n, places[np.minimum(a + shared, n - 1)], text.size) - places[np.maximum(a, 0)]
        common = text.common(places[np.maximum(a, 0)], places[own], np.maximum(start, 0), depth)
        yield places[own], np.where(a < 0, 0, common)


def turned(rows: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (place, shared with the row before) of a falling order as rows of the rising one, without place ``n``."""
    shared_after = 0
    for y in range(len(rows), 0, -BLOCK):
        part = np.array(rows[max(0, y - BLOCK) : y])[::-1]
        shared = np.concatenate(([shared_after], part[:-1, 1]))
        shared_after = int(part[-1, 1])
        keep = part[:, 0] != n
        yield part[keep, 0], shared[keep]


def suffixes(
    text: Text, depth: int, folder: str, rows_held: int = ROWS_HELD, names_held: int = NAMES_HELD,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest to the smallest, block by block: places and what each shares with the one before."""
    depth = min(depth, (1 << SHARED_BITS) - 1)
    top = max((int(text.symbols[x : x + READ].max()) for x in range(0, text.size, READ)), default=0)
    queue = BucketQueue(folder, 1, rows_held)
    rising = Pass(text, depth, queue, top + 1)
    falls, buckets = Rows(folder, 1), []  # place and shared prefix in one number
    last = np.array([[text.size - 1, 0, 0]])
    last[:, 2] = text.before(last[:, 0]).view(np.int64)
    queue.push([int(text.symbols[text.size - 1])], [0, 1], last)
    places = rises(text, folder)
    seeds = _by_symbol(text, sorted_rises(text, places, depth, folder, rows_held, names_held)) if len(places) else iter(())
    seed = next(seeds, None)
    while queue.first() is not None or seed is not None:
        symbol = min(x for x in (queue.first(), seed and seed[0]) if x is not None)
        start, end_place = falls.n, None
        if symbol == queue.first():
            for rows in queue.pop(symbol):
                falls.add(rows[:, :1] << SHARED_BITS | rows[:, 1:2])
                end_place = int(rows[-1, 0])
                rising.take(rows, symbol, top)
            buckets.append((symbol, start, falls.n))
        while seed is not None and seed[0] == symbol:
            rows = seed[1]
            if end_place is not None:
                rows[0, 1] = min(text.run(end_place, depth), text.run(int(rows[0, 0]), depth))
                end_place = None
            rising.take(rows, symbol, top)
            seed = next(seeds, None)
    queue.drop()
    fallen = falls.done()[:, 0]
    queue = BucketQueue(folder, -1, rows_held)
    falling = Pass(text, depth, queue, top + 1)
    while queue.first() is not None or buckets:
        symbol = max(x for x in (queue.first(), buckets[-1][0] if buckets else None) if x is not None)
        end_place = None
        if symbol == queue.first():
            for rows in queue.pop(symbol):
                end_place = int(rows[-1, 0])
                falling.take(rows, 0, symbol)
                yield rows[:, 0], rows[:, 1]
        if buckets and buckets[-1][0] == symbol:
            _, start, end = buckets.pop()
            shared_after = 0 if end_place is None else min(text.run(end_place, depth), text.run(int(fallen[end - 1]) >> SHARED_BITS, depth))
            for y in range(end, start, -BLOCK):
                packed = np.array(fallen[max(start, y - BLOCK) : y])[::-1]
                places, own = packed >> SHARED_BITS, packed & ((1 << SHARED_BITS) - 1)
                shared = np.concatenate(([shared_after], own[:-1]))
                rows = np.stack([places, shared, text.before(places).view(np.int64)], axis=1)
                shared_after = int(own[-1])
                falling.take(rows, 0, symbol - 1)
                yield rows[:, 0], rows[:, 1]
    queue.drop()
    del fallen
    falls.drop()


def _by_symbol(text: Text, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of S* suffixes as rows of one first symbol each."""
    for places, shared in blocks:
        if not len(places):
            continue
        symbols = text.symbols[places].astype(np.int64)
        rows = np.stack([places, shared, text.before(places).view(np.int64)], axis=1)
        cuts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1]))).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            yield int(symbols[x]), rows[x:y].copy()
