"""External induced sorting of suffixes, with the lengths of common prefixes carried along.

A level sorts the substrings between local minima, names them and recurs on the names. The order of the minima induces
that of the suffixes that descend to one, and these induce that of those that ascend. Each suffix is a tuple: the symbols
of its run, the rank of the suffix that it is induced from, its place. Tuples go through a priority queue that keeps
sorted runs on disk, and what arrays do not fit the room are files, too: a text may be far larger than memory. Common
prefixes are carried from level to level: those of two suffixes are their runs' and what lies between the ranks they are
induced from. They count up to a cap, and beyond it order does not matter.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np


class Space:
    """Room for rows in memory; beyond it, files in a folder of their own that goes in the end."""

    def __init__(self, room: int = 1 << 23):
        self.room, self._folder, self._n = room, None, 0

    def path(self) -> str:
        self._folder = self._folder or tempfile.mkdtemp(prefix="suffixes-")
        self._n += 1
        return os.path.join(self._folder, str(self._n))

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.room:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def blocks(self, n: int) -> Iterator[slice]:
        for k in range(0, n, self.room):
            yield slice(k, min(n, k + self.room))

    def close(self) -> None:
        if self._folder:
            shutil.rmtree(self._folder, ignore_errors=True)


class Queue:
    """Tuples of int64 in ascending order of all but the last column. Pushed batches become sorted runs, on disk but for the last."""

    def __init__(self, space: Space):
        self.space, self.held, self.rows, self.runs = space, [], 0, []

    def push(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.rows += len(columns[0])
        if self.rows >= self.space.room:
            path = self.space.path()
            np.save(path, np.stack(self._sorted()))
            self.runs.append(path + ".npy")

    def _sorted(self) -> list[np.ndarray]:
        cols = [np.concatenate(x) for x in zip(*self.held)] if len(self.held) > 1 else list(self.held[0])
        self.held, self.rows = [], 0
        at = np.lexsort(cols[-2::-1]) if len(cols) > 2 else np.argsort(cols[0], kind="stable")
        return [c[at] for c in cols]

    def pop(self) -> Iterator[list[np.ndarray]]:
        """All tuples in batches. The run whose block ends first bounds what goes out next."""
        last = self._sorted() if self.held else None
        if not self.runs:
            if last:
                yield last
            return
        runs = [np.load(p, mmap_mode="r") for p in self.runs] + ([np.stack(last)] if last else [])
        size = max(64, self.space.room // len(runs))
        heads, stops = [0] * len(runs), [min(size, r.shape[1]) for r in runs]  # of each run's block
        end = lambda k: (tuple(runs[k][:-1, stops[k] - 1].tolist()), k)
        ends = [end(k) for k in range(len(runs))]
        heapq.heapify(ends)
        while ends:
            bound, owner = heapq.heappop(ends)
            out = []
            for k, r in enumerate(runs):
                block = np.array(r[:, heads[k]:stops[k]])
                n = block.shape[1] if k == owner else self._upto(block, bound)
                out.append(block[:, :n])
                heads[k] += n
            stops[owner] = min(heads[owner] + size, runs[owner].shape[1])
            if heads[owner] < stops[owner]:
                heapq.heappush(ends, end(owner))
            cols = list(np.concatenate(out, axis=1))
            at = np.lexsort(cols[-2::-1])
            if len(at):
                yield [c[at] for c in cols]
        for p in self.runs:
            os.remove(p)

    @staticmethod
    def _upto(block: np.ndarray, bound: tuple) -> int:
        """How many tuples of a sorted block are not above the bound."""
        lo, hi = 0, block.shape[1]
        for column, b in zip(block[:-1], bound):
            left = lo + int(np.searchsorted(column[lo:hi], b, "left"))
            right = lo + int(np.searchsorted(column[lo:hi], b, "right"))
            lo, hi = left, right
        return hi


class _Least:
    """Minima over ranges of an array of bytes."""

    def __init__(self, values: np.ndarray, space: Space):
        self.levels = [values]
        n, k = len(values), 1
        while 2 * k <= n:
            last = self.levels[-1]
            now = space.array(n - 2 * k + 1, np.uint8)
            for b in space.blocks(len(now)):
                np.minimum(last[b], last[b.start + k:b.stop + k], out=now[b])
            self.levels.append(now)
            k *= 2

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over places a + 1 to b, for a < b."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.uint8)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            table = self.levels[level]
            out[at] = np.minimum(table[a[at] + 1], table[b[at] + 1 - (1 << level)])
        return out


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, cap: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, from a known start on."""
    out = np.minimum(start, cap)
    at = np.flatnonzero(out < cap)
    while len(at):
        at = at[t[a[at] + out[at]] == t[b[at] + out[at]]]  # the last symbol is unlike all others, so none is passed
        out[at] += 1
        at = at[out[at] < cap]
    return out.astype(np.uint8)


class _Level:
    """A text of symbols, the last of which is the least and occurs once."""

    def __init__(self, t: np.ndarray, cap: int, space: Space):
        self.t, self.cap, self.space = t, cap, space
        n = len(t)
        self.up = space.array(n, bool)  # whether the suffix is less than the next
        self.up[n - 1] = True
        stop = n - 1
        while stop > 0:
            start = max(0, stop - space.room)
            part, after = t[start:stop], t[start + 1:stop + 1]
            differs = np.flatnonzero(part != after)
            said = np.empty(len(part), bool)
            rises = after[differs] > part[differs]
            before = np.r_[-1, differs]
            said[: before[-1] + 1] = np.repeat(rises, np.diff(before))
            said[before[-1] + 1:] = self.up[stop]
            self.up[start:stop] = said
            stop = start
        top = 0
        for b in space.blocks(n):
            top = max(top, int(t[b].max()))
        self.bits = (2 * top + 1).bit_length()
        self.per = max(1, 62 // self.bits)

    def _key(self, at: np.ndarray, last: np.ndarray, skip: int) -> np.ndarray:
        """per symbols and directions from at + skip on, none beyond last."""
        out = np.zeros(len(at), np.int64)
        for x in range(skip, skip + self.per):
            there = at + x <= last
            p = np.where(there, at + x, 0)
            out = (out << self.bits) | np.where(there, 2 * self.t[p].astype(np.int64) + self.up[p], 0)
        return out

    def sort(self, at: np.ndarray, last: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The order of the runs from at to last, and then of the ranks at last; whether each run equals the one before it."""
        n, space = len(at), self.space
        order, same = space.array(n, np.int64), space.array(n, bool)

        def second(i: np.ndarray, done: int) -> np.ndarray:
            return np.zeros(len(i), np.int64) if rank is None else np.where(last[i] - at[i] < done, rank[last[i]], 0)

        def fill(queue: Queue, slots: np.ndarray | None) -> None:
            """What the queue gives goes to slots, in order; tuples are (group, key, rank, place)."""
            k, before = 0, (-1, -1)
            for group, key, _, i in queue.pop():
                own = np.r_[group[0] == before[0] and key[0] == before[1], (group[1:] == group[:-1]) & (key[1:] == key[:-1])]
                to = slice(k, k + len(i)) if slots is None else slots[k:k + len(i)]
                order[to] = i
                same[to] = own
                k, before = k + len(i), (int(group[-1]), int(key[-1]))

        queue = Queue(space)
        for b in space.blocks(n):
            i = np.arange(b.start, b.stop)
            queue.push(np.zeros(len(i), np.int64), self._key(at[b], last[b], 0), second(i, self.per), i)
        fill(queue, None)
        done, slots = self.per, None
        while done <= self.cap:
            among = np.arange(n) if slots is None else slots
            tied = same[among] | np.r_[(same[among[1:]]) & (among[1:] == among[:-1] + 1), False]
            open_ = last[order[among]] - at[order[among]] >= done
            slots = among[tied & open_]
            if not len(slots):
                break
            starts = ~same[slots] | np.r_[True, slots[1:] != slots[:-1] + 1]
            group = np.cumsum(starts)
            queue = Queue(space)
            for b in space.blocks(len(slots)):
                i = order[slots[b]]
                queue.push(group[b], self._key(at[i], last[i], done), second(i, done + self.per), i)
            fill(queue, slots)
            done += self.per
        return order, same

    def carried(self, ordered: np.ndarray, same: np.ndarray, last: np.ndarray, rank: np.ndarray, least: _Least) -> np.ndarray:
        """Common prefixes of each suffix with the one before it; last: where each one's run ends."""
        out = self.space.array(len(ordered), np.uint8)
        for b in self.space.blocks(len(ordered)):
            k = np.arange(max(1, b.start), b.stop)
            eq = same[k]
            i = k[eq]
            ra, rb = rank[last[i - 1]], rank[last[i]]
            run = last[i] - ordered[i]
            got = np.full(len(i), self.cap, np.int64)
            short = (run < self.cap) & (ra < rb)
            got[short] = np.minimum(self.cap, run[short] + least.between(ra[short], rb[short]))
            out[i] = got
            i = k[~eq]
            out[i] = _common(self.t, ordered[i - 1], ordered[i], np.zeros(len(i), np.int64), self.cap)
        return out

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        t, space, n, up = self.t, self.space, len(self.t), self.up
        if n == 1:
            return np.zeros(1, np.int64), np.zeros(1, np.uint8)
        turns = np.concatenate([np.flatnonzero(up[b.start + 1:b.stop + 1] != up[b][: len(up[b.start + 1:b.stop + 1])]) + b.start + 1 for b in space.blocks(n)])
        minima = turns[up[turns]]
        m = len(minima)
        order, same = self.sort(minima, np.r_[minima[1:], minima[-1]], None)
        named = np.cumsum(~same) - 1
        if named[-1] == m - 1:
            sa, equal = order, np.zeros(m, np.uint8)
        else:
            names = space.array(m, np.int64)
            names[order] = named
            sa, equal = _Level(names, self.cap, space).suffixes()
        rank = space.array(n, np.int64)
        stars = minima[sa]
        rank[stars] = np.arange(m)
        known = minima[np.minimum(sa + equal, m - 1)] - stars
        carried = space.array(m, np.uint8)
        for b in space.blocks(m):
            k = np.arange(max(1, b.start), b.stop)
            carried[k] = _common(t, stars[k - 1], stars[k], known[k], self.cap)

        def induced(rising: bool, least: _Least) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(up[:n - 1] == rising)
            last = turns[np.searchsorted(turns, at, "right")] if len(at) else at
            order, same = self.sort(at, last, rank)
            ordered, last = at[order], last[order]
            out = self.carried(ordered, same, last, rank, least)
            rank[ordered] = np.arange(len(ordered))
            return ordered, out

        falling, lf = induced(False, _Least(carried, space))
        rising, lr = induced(True, _Least(lf, space))
        rising, lr = np.r_[n - 1, rising], np.r_[np.uint8(0), lr]
        f, r = t[falling], t[rising]
        out, common = space.array(n, np.int64), space.array(n, np.uint8)
        to = np.arange(len(falling)) + np.searchsorted(r, f, "left")
        out[to], common[to] = falling, lf
        to = np.arange(len(rising)) + np.searchsorted(f, r, "right")
        out[to], common[to] = rising, lr
        seam = to[np.r_[True, r[1:] != r[:-1]]]
        seam = seam[seam > 0]
        common[seam] = _common(t, out[seam - 1], out[seam], np.zeros(len(seam), np.int64), self.cap)
        return out, common


def suffixes(t: np.ndarray, cap: int, room: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of t in order of their first cap symbols, and each one's common prefix with the one before, up to cap.

    The last symbol of t must be less than all others. cap is 255 at most.
    """
    space = Space(room)
    try:
        return tuple(np.array(x) for x in _Level(t, cap, space).suffixes())
    finally:
        space.close()


def repeated(t: np.ndarray, length: int, room: int = 1 << 23) -> np.ndarray:
    """Whether the length symbols from each place on occur at another place, too: neighbours in order share them."""
    space = Space(room)
    try:
        order, common = _Level(t, length, space).suffixes()
        out = np.zeros(len(t), bool)
        for b in space.blocks(len(t)):
            at = np.flatnonzero(common[b] >= length) + b.start
            out[order[at]] = True
            out[order[at - 1]] = True
        return out
    finally:
        space.close()
