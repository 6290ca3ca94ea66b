"""Suffix order of a shard by induced sorting with disk-backed queues that carry common-prefix values.

The leftmost S-type suffixes (one in three at most) are sorted first, by names of their substrings that are doubled
until they cover the depth asked for; all others are induced from them, L-type suffixes over the buckets in rising
order and S-type ones in falling order. A bucket's queue holds, in the order in which they were induced, positions
and the length of the prefix that each shares with the one in front: one more than the least such value between the
two suffixes that induced them. The rounds of one bucket are whole-array steps. What waits in queues beyond a memory
budget lies in a temporary file.
"""

from __future__ import annotations

import tempfile

import numpy as np

NONE = np.zeros((2, 0), np.int32)


class Queues:
    """A first-in first-out queue of (position, value) columns, 32 bits each, for each symbol.

    Over budget entries in memory, all are written to a file without a name in the worker's own scratch folder: like
    Spark's shuffle spill it is gone with the task, and a task that runs again elsewhere writes its own.
    """

    def __init__(self, symbols: int, budget: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.budget, self.file = 0, budget, None

    def push(self, symbol: int, entries: np.ndarray) -> None:
        if entries.shape[1]:
            self.parts[symbol].append(entries)
            self.held += entries.shape[1]
            if self.held > self.budget:
                self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.parts:
            for k, p in enumerate(parts):
                if isinstance(p, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(np.ascontiguousarray(p).tobytes())
                    parts[k] = (at, p.shape[1])
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All of a symbol's queue, which is empty afterwards."""
        out = []
        for p in self.parts[symbol]:
            if isinstance(p, np.ndarray):
                self.held -= p.shape[1]
                out.append(p)
            else:
                self.file.seek(p[0])
                out.append(np.frombuffer(self.file.read(p[1] * 8), np.int32).reshape(2, -1))
        self.parts[symbol] = []
        return np.concatenate(out, 1) if out else NONE

    def close(self) -> None:
        if self.file:
            self.file.close()


class Carried:
    """The least common-prefix value met since each symbol's last entry."""

    def __init__(self, symbols: int, depth: int):
        self.since, self.begun, self.depth = np.full(symbols, depth, np.int32), np.zeros(symbols, bool), np.int32(depth)

    def entries(self, values: np.ndarray, symbol: np.ndarray, index: np.ndarray, position: np.ndarray):
        """(symbol, its new entries) induced by a scanned block with these values, from its places index."""
        if not len(values):
            return
        order = np.argsort(symbol, kind="stable")
        symbol, index, position = symbol[order], index[order], position[order]
        heads = np.flatnonzero(np.diff(symbol, prepend=-1))
        before, self.since = self.since, np.minimum(self.since, values.min())
        if not len(symbol):
            return
        for a, b in zip(heads, np.append(heads[1:], len(symbol)), strict=True):
            c, cuts = symbol[a], np.concatenate(([0], index[a:b] + 1))
            least = np.minimum.reduceat(values, cuts[cuts < len(values)])
            shared = np.minimum(least[: b - a] + 1, self.depth)
            shared[0] = min(before[c] + 1, shared[0]) if self.begun[c] else 0
            self.begun[c], self.since[c] = True, least[b - a] if len(least) > b - a else self.depth
            yield c, np.stack((position[a:b], shared))


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type positions; the end, the only 0, is one, and what stands before it isn't."""
    heads = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    after = np.append(t[heads[1:]], np.iinfo(t.dtype).max)
    return np.repeat(t[heads] < after, np.diff(np.append(heads, len(t))))


def _packed(t: np.ndarray) -> np.ndarray:
    """Four symbols from each position on; past the end, symbols that differ from all others."""
    wide = np.concatenate((t.astype(np.uint64), np.full(3, 0x7FFF, np.uint64)))
    n = len(t)
    return wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)


def _shared(packed: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the prefix that the suffixes at a and b share, at most depth. The end symbol stands once, so no pair runs past it."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    x, y = a, b
    for k in range(0, depth, 4):
        differ = packed[x] ^ packed[y]
        same = differ == 0
        part = differ[~same]
        low = (part & np.uint64(0xFFFF) == 0).astype(np.int64)
        low += low * (part & np.uint64(0xFFFF0000) == 0)
        low += (low == 2) * (part & np.uint64(0xFFFF00000000) == 0)
        out[live[~same]] = k + low
        live, x, y = live[same], x[same] + 4, y[same] + 4
        if not len(live):
            break
    out[live] = depth
    return np.minimum(out, depth)


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int, budget: int, depth: int):
    """Blocks of (position, value) in suffix order, induced from seeds (leftmost S-type positions in order)."""
    cut = np.searchsorted(t[seeds], np.arange(symbols + 1))
    packed = _packed(t)
    one = lambda a, b: _shared(packed, np.array([a]), np.array([b]), depth)[0]
    common = np.concatenate(([0], _shared(packed, seeds[:-1], seeds[1:], depth))).astype(np.int32)
    seeds = seeds.astype(np.int32)
    rising, large, carried = Queues(symbols, budget), Queues(symbols, budget), Carried(symbols, depth)
    for c in range(symbols):
        now, last = rising.pop(c), None
        while now.shape[1]:
            large.push(c, now)
            last = now[0, -1]
            at = np.flatnonzero(now[0] > 0)
            front = now[0, at] - 1
            ok = t[front] >= c
            again = NONE
            for symbol, entries in carried.entries(now[1], t[front[ok]], at[ok], front[ok]):
                if symbol == c:
                    again = entries
                else:
                    rising.push(symbol, entries)
            now = again
        block, values = seeds[cut[c] : cut[c + 1]], common[cut[c] : cut[c + 1]].copy()
        if len(block):
            values[0] = 0 if last is None else one(last, block[0])
            at = np.flatnonzero(block > 0)
            front = block[at] - 1
            ok = ~small[front]
            for symbol, entries in carried.entries(values, t[front[ok]], at[ok], front[ok]):
                rising.push(symbol, entries)
    rising.close()
    falling, blocks, carried = Queues(symbols, budget), Queues(2 * symbols, budget), Carried(symbols, depth)
    for c in range(symbols - 1, -1, -1):
        now, out = falling.pop(c), []
        while now.shape[1]:
            out.append(now)
            at = np.flatnonzero(now[0] > 0)
            front = now[0, at] - 1
            ok = small[front] & (t[front] <= c)
            again = NONE
            for symbol, entries in carried.entries(now[1], t[front[ok]], at[ok], front[ok]):
                if symbol == c:
                    again = entries
                else:
                    falling.push(symbol, entries)
            now = again
        first, down = np.concatenate(out, 1) if out else NONE, large.pop(c)
        seam = one(first[0, -1], down[0, -1]) if first.shape[1] and down.shape[1] else 0
        blocks.push(2 * c, down)
        if first.shape[1]:
            blocks.push(2 * c + 1, np.stack((first[0, ::-1], np.concatenate((np.array([seam], np.int32), first[1, :0:-1])))))
        if down.shape[1]:
            back = np.stack((down[0, ::-1], np.concatenate((np.array([seam], np.int32), down[1, :0:-1]))))
            at = np.flatnonzero(back[0] > 0)
            front = back[0, at] - 1
            ok = t[front] < c
            for symbol, entries in carried.entries(back[1], t[front[ok]], at[ok], front[ok]):
                falling.push(symbol, entries)
    falling.close()
    large.close()
    for k in range(2 * symbols):
        block = blocks.pop(k)
        if block.shape[1]:
            yield block
    blocks.close()


def suffix_blocks(text: np.ndarray, depth: int, budget: int = 1 << 18):
    """Blocks of (position, value) of text (symbols 0..256) in the order of their next depth symbols at least.

    value is the length, at most depth, of the prefix that a suffix shares with the one in front. The text is followed
    by an end that is smaller than all.
    """
    t = np.concatenate((text.astype(np.int16) + 1, [0])).astype(np.int16)
    small = _types(t)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    symbols = int(t.max()) + 1
    # names of the substrings from one seed to the next: an induced order of unsorted seeds, then equal neighbours
    rough = seeds[np.argsort(t[seeds], kind="stable")]
    is_seed = np.zeros(len(t), bool)
    is_seed[seeds] = True
    order = np.concatenate([b[0][is_seed[b[0]]] for b in _induce(t, small, rough, symbols, budget, 1)] or [seeds])
    missing = np.setdiff1d(seeds, order, assume_unique=True)  # the end itself isn't induced
    order = np.concatenate((missing, order)) if len(missing) else order
    index = np.zeros(len(t), np.int64)
    index[seeds] = np.arange(len(seeds))
    size = np.diff(np.append(seeds, len(t) - 1)) + 1
    rank = index[order]
    new = np.ones(len(order), bool)
    new[1:] = ~_same(t, order[:-1], order[1:], size[rank[:-1]], size[rank[1:]])
    name = np.zeros(len(seeds), np.int64)
    name[rank] = np.cumsum(new)
    # recursion on the reduced text, as far as depth needs: names of two, four, ... substrings
    covered = 1
    while covered < depth and len(seeds) > 1 and int(name.max()) < len(seeds):
        after = np.zeros(len(name), np.int64)
        after[:-covered] = name[covered:] if covered < len(name) else 0
        name = np.unique(name * (len(name) + 2) + after, return_inverse=True)[1] + 1
        covered *= 2
    yield from _induce(t, small, seeds[np.argsort(name, kind="stable")], symbols, budget, depth)


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether substrings at a and b of the given sizes are equal."""
    same = size_a == size_b
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[size_a[live] > k]
        differ = t[a[live] + k] != t[b[live] + k]
        same[live[differ]] = False
        live, k = live[~differ], k + 1
    return same
