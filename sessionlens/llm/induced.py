"""External induced suffix sorting with common prefixes.

A suffix is typed by whether it is less than the next one; the leftmost of such suffixes in each run cut the text
into substrings. These are sorted and named, the string of names is sorted by recursion, and what it says is carried
back: every suffix becomes a tuple of its typed symbols up to the next cut, and the rank of that cut. Tuples go
through priority queues that keep sorted runs on disk and merge them block by block; texts, names, ranks and prefixes
are files mapped into memory once they are long. So memory follows the bound that is given and not the text.

The common prefix of neighbours is carried along: where two tuples part, the queue's neighbours tell the symbol; where
they don't, the cuts' own common prefix is the least of those between their ranks, from the recursion. Lengths count
symbols of the first text and stop at a cap.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Parts of what may stay in memory that are handled one at a time.
_PARTS = 8


class Disk:
    """Arrays and queues of one sort: in memory while short, else in files of a folder of this task."""

    def __init__(self, tuples: int, folder: str) -> None:
        self.tuples, self.folder, self.files = max(tuples, 64), folder, 0
        #: Rows handled at once.
        self.rows = max(64, self.tuples // _PARTS)

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def empty(self, n: int, dtype: type = np.int64) -> np.ndarray:
        if n <= self.tuples:
            return np.empty(n, dtype=dtype)
        return np.memmap(self.path(), dtype=dtype, mode="w+", shape=(n,))

    def parts(self, n: int) -> Iterator[slice]:
        step = n if n <= self.tuples else self.rows
        for at in range(0, n, max(step, 1)):
            yield slice(at, min(n, at + step))


class Queue:
    """A priority queue of tuples of integers, filled first and emptied in order then.

    Beyond the bound the tuples lie on disk in sorted runs. Emptying reads a block of each run; what is not above the
    least of the blocks' last keys can't be overtaken and leaves together.
    """

    def __init__(self, disk: Disk, keys: int = 2) -> None:
        """keys: of how many first columns the order is, one or two."""
        self.disk, self.keys = disk, keys
        self.held: list[list[np.ndarray]] = []
        self.n = 0
        self.runs: list[np.ndarray] = []

    def push(self, *cols: np.ndarray) -> None:
        self.held.append([np.asarray(c, dtype=np.int64) for c in cols])
        self.n += len(cols[0])
        if self.n > self.disk.tuples:
            self._run()

    def _order(self, cols: list[np.ndarray]) -> np.ndarray:
        keys = [(c, int(c.min()), int(c.max())) for c in cols[: self.keys]]
        keys = [(c, low, high) for c, low, high in keys if low < high]
        if not keys:
            return np.arange(len(cols[0]))
        if len(keys) == 1:
            return np.argsort(keys[0][0])
        (a, a0, a1), (b, b0, b1) = keys
        if (a1 - a0 + 1) * (b1 - b0 + 1) < 1 << 62:  # both fit one number
            return np.argsort((a - a0) * (b1 - b0 + 1) + (b - b0))
        return np.lexsort((b, a))

    def _sorted(self, cols: list[np.ndarray]) -> list[np.ndarray]:
        order = self._order(cols)
        return [c[order] for c in cols]

    def _run(self) -> None:
        cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.n = [], 0
        order = self._order(cols)
        run = np.memmap(self.disk.path(), dtype=np.int64, mode="w+", shape=(len(cols), len(order)))
        for k, c in enumerate(cols):
            run[k] = c[order]
        run.flush()
        self.runs.append(run)

    def pop(self) -> Iterator[list[np.ndarray]]:
        if not self.runs:
            if self.n:
                cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
                self.held = []
                yield self._sorted(cols)
            return
        if self.n:
            self._run()
        at = [0] * len(self.runs)
        block = max(16, self.disk.tuples // (2 * len(self.runs)))
        live = list(range(len(self.runs)))
        while live:
            ends = {r: min(at[r] + block, self.runs[r].shape[1]) for r in live}
            last = [tuple(self.runs[r][: self.keys, ends[r] - 1].tolist()) for r in live if ends[r] < self.runs[r].shape[1]]
            taken = []
            for r in live:
                part = np.array(self.runs[r][:, at[r] : ends[r]])
                if last:
                    part = part[:, : self._upto(part, min(last))]
                at[r] += part.shape[1]
                taken.append(part)
            live = [r for r in live if at[r] < self.runs[r].shape[1]]
            yield self._sorted(list(np.concatenate(taken, axis=1)))

    def _upto(self, part: np.ndarray, key: tuple[int, ...]) -> int:
        """Tuples of a sorted part that aren't above the key."""
        low, high = 0, part.shape[1]
        for c, k in zip(part[: self.keys], key, strict=True):
            below = low + int(np.searchsorted(c[low:high], k, side="left"))
            above = low + int(np.searchsorted(c[low:high], k, side="right"))
            if below == above:
                return below
            low, high = below, above
        return high


class Least:
    """The least value of any range, by a table of powers of two; over small blocks where values are many."""

    BLOCK = 4

    def __init__(self, disk: Disk, values: np.ndarray) -> None:
        self.values = values
        self.block = self.BLOCK if 4 * len(values) > disk.tuples else 1
        n = -(-len(values) // self.block)
        sizes = [n]
        while (wide := 1 << len(sizes)) <= n:
            sizes.append(n - wide + 1)
        self.starts = np.cumsum([0, *sizes])
        self.table = disk.empty(int(self.starts[-1]), np.int32)
        for part in disk.parts(n):
            v = values[part.start * self.block : part.stop * self.block]
            self.table[part] = np.minimum.reduceat(v, np.arange(0, len(v), self.block)) if self.block > 1 else v
        for p in range(1, len(sizes)):
            below, row = self.starts[p - 1], self.starts[p]
            for part in disk.parts(sizes[p]):
                one = self.table[below + part.start : below + part.stop]
                wide = 1 << (p - 1)
                self.table[row + part.start : row + part.stop] = np.minimum(one, self.table[below + wide + part.start : below + wide + part.stop])

    def _rows(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least of the blocks begin..end, the last excluded."""
        power = np.frexp((end - begin).astype(np.float64))[1].astype(np.int64) - 1
        row = self.starts[power]
        return np.minimum(self.table[row + begin], self.table[row + end - (1 << power)])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value in each low..high, both included."""
        if self.block == 1:
            return self._rows(low, high + 1).astype(np.int64)
        out = np.minimum(self.values[low], self.values[high]).astype(np.int64)
        live = np.flatnonzero(high - low > 1)
        for s in range(1, self.block):  # inwards from both ends, up to whole blocks
            a, b = low[live] + s, high[live] - s
            out[live] = np.minimum(out[live], np.minimum(self.values[np.minimum(a, b)], self.values[np.maximum(a, b)]))
            live = live[b - a > 1]
        begin, end = low[live] // self.block + 1, high[live] // self.block
        live, begin, end = live[begin < end], begin[begin < end], end[begin < end]
        out[live] = np.minimum(out[live], self._rows(begin, end))
        return out


class Text:
    """One level of the recursion: a text whose last symbol is the single least one."""

    def __init__(self, disk: Disk, symbols: np.ndarray, places: np.ndarray | None = None, below: Text | None = None) -> None:
        """places: where each symbol begins in the text below; None at the first level."""
        self.disk, self.symbols, self.places, self.below = disk, symbols, places, below
        n = self.n = len(symbols)
        top = max((int(symbols[part].max()) for part in disk.parts(n)), default=0)
        self.bits = (2 * top + 2).bit_length()
        self.per = max(1, 62 // self.bits)
        #: For each position its typed symbol (plus one) and those behind it, `per` in all, in one number.
        self.packed, self.run = disk.empty(n), disk.empty(n)
        self.apart: Least | None = None  # typed symbols that neighbouring names of the next text share
        cuts, small_after, ends, behind = [], False, n - 1, np.zeros(self.per - 1, dtype=np.int64)
        for part in reversed(list(disk.parts(n))):
            x = np.asarray(symbols[part], dtype=np.int64)
            following = np.append(x[1:], symbols[part.stop] if part.stop < n else -1)
            step = following - x
            at = np.arange(part.start, part.stop)
            turn = np.where(step != 0, at, np.iinfo(np.int64).max)
            turn = np.minimum.accumulate(turn[::-1])[::-1]  # where the run of equal symbols ends
            open_ = turn == np.iinfo(np.int64).max
            small = np.where(open_, small_after, step[np.minimum(turn, part.stop - 1) - part.start] > 0)
            if part.stop == n:
                small[-1] = True
            turn = np.where(open_, ends, turn)
            self.run[part] = turn - at + 1
            typed = np.concatenate([2 * x + small + 1, behind])
            key = typed[: len(x)].copy()
            for t in range(1, self.per):
                key <<= self.bits
                key |= typed[t : t + len(x)]
            self.packed[part] = key
            behind = typed[: self.per - 1]
            left = small[1:] & ~small[:-1]
            if part.stop < n and small_after and not small[-1]:
                cuts.append(np.array([part.stop]))
            cuts.append(np.flatnonzero(left) + 1 + part.start)
            ends, small_after = int(turn[0]), bool(small[0])
        self.cuts = disk.empty(sum(map(len, cuts)))
        at = 0
        for c in reversed(cuts):
            self.cuts[at : at + len(c)] = c
            at += len(c)

    def first_text(self, at: np.ndarray) -> np.ndarray:
        """Positions in the first text."""
        return at if self.below is None else self.below.first_text(np.asarray(self.places[at]))

    def parted(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols of the first text that two positions of different symbols share from there on."""
        if self.below is None:
            return np.zeros(len(i), dtype=np.int64)
        a, b = np.asarray(self.symbols[i], dtype=np.int64), np.asarray(self.symbols[j], dtype=np.int64)
        shared = self.below.apart.of(np.minimum(a, b) + 1, np.maximum(a, b))
        return self.below.shared(np.asarray(self.places[i]), np.asarray(self.places[j]), shared)

    def shared(self, i: np.ndarray, j: np.ndarray, typed: np.ndarray) -> np.ndarray:
        """Symbols of the first text that i and j share, whose typed symbols part after `typed` equal ones.

        There the symbols differ, or only the types do: then the shorter of two runs of one symbol ends first."""
        p, q = i + typed, j + typed
        same = self.symbols[p] == self.symbols[q]
        more = np.where(same, np.minimum(self.run[p], self.run[q]), 0)
        p, q = p + more, q + more
        return self.first_text(p) - self.first_text(i) + self.parted(p, q)

    def _keys(self, at: np.ndarray, ends: np.ndarray, off: int) -> np.ndarray:
        """The typed symbols from `off` on, as one number; nothing counts behind a sequence's end."""
        none = np.clip(off + self.per - (ends - at + 1), 0, self.per) * self.bits
        return (self.packed[np.minimum(at + off, ends)] >> none) << none

    def sequences(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, apart) of the sequences typed[start..end]: rank is the number of sequences before the first equal
        one; apart[rank] the typed symbols shared with the sequence before. No sequence is a proper prefix of another,
        as the last symbol's type tells them apart."""
        disk, n = self.disk, len(starts)
        rank, apart = disk.empty(n), disk.empty(n, np.int32)
        for part in disk.parts(n):
            rank[part], apart[part] = 0, 0
        live = (np.arange(part.start, part.stop) for part in disk.parts(n))
        off = 0
        while True:
            queue = Queue(disk)
            some = False
            for idx in live:
                some = True
                queue.push(rank[idx], self._keys(np.asarray(starts[idx]), np.asarray(ends[idx]), off), idx)
            if not some:
                return rank, apart
            live = self._refined(queue, rank, apart, np.asarray(starts), np.asarray(ends), off)
            live = list(live) if n <= disk.tuples else self._kept(live)
            off += self.per

    def _kept(self, live: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """Row numbers through a file, so that the queue before can go."""
        path = self.disk.path()
        with open(path, "wb") as f:
            for idx in live:
                idx.tofile(f)
        n = os.path.getsize(path) // 8
        if not n:
            return iter(())
        rows = np.memmap(path, dtype=np.int64, mode="r", shape=(n,))
        return (np.array(rows[at : at + self.disk.rows]) for at in range(0, n, self.disk.rows))

    def _refined(self, queue: Queue, rank: np.ndarray, apart: np.ndarray, starts: np.ndarray, ends: np.ndarray, off: int) -> Iterator[np.ndarray]:
        """Set rank and apart from tuples (rank so far, key, row); gives the rows whose order is still open."""
        seen, base, first, before, waiting = 0, 0, 0, None, None
        for r, k, idx in queue.pop():
            m = len(r)
            r0 = np.concatenate([[before[0] if before else -1], r[:-1]])
            k0 = np.concatenate([[before[1] if before else -1], k[:-1]])
            group = r != r0
            new = group | (k != k0)
            at = np.arange(seen, seen + m)
            bases = np.maximum(np.maximum.accumulate(np.where(group, at, -1)), base)
            firsts = np.maximum(np.maximum.accumulate(np.where(new, at, -1)), first)
            now = r + firsts - bases
            split = np.flatnonzero(new & ~group)
            if len(split):
                differ = k[split] ^ k0[split]
                bit = np.frexp(differ.astype(np.float64))[1] - 1
                # rounding may lift a number to the next power of two
                bit = np.where((differ >> np.minimum(bit, 62)) == 0, bit - 1, bit)
                apart[now[split]] = off + self.per - 1 - bit // self.bits
            rank[idx] = now
            # a row is open while a neighbour equals it and its sequence goes on
            equal = np.concatenate([~new[1:], [False]]) | ~new
            if waiting is not None and not new[0]:
                yield waiting
            more = ends[idx] - starts[idx] + 1 > off + self.per
            waiting = idx[-1:] if more[-1] and new[-1] else None
            keep = idx[equal & more]
            if len(keep):
                yield keep
            seen, base, first, before = seen + m, int(bases[-1]), int(firsts[-1]), (int(r[-1]), int(k[-1]))

    def sorted(self, wanted: np.ndarray | None, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the order of their suffixes, symbols of the first text that each shares with the one before,
        at most `cap`); of all positions or the wanted ones."""
        disk, cuts = self.disk, self.cuts
        n = len(cuts)
        if not n:  # the last symbol alone
            total = self.n if wanted is None else len(wanted)
            return np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int32)
        ends = disk.empty(n)
        ends[:-1], ends[-1] = cuts[1:], cuts[-1]
        rank, apart = self.sequences(cuts, ends)
        # dense names in the order of the ranks, and the typed symbols that neighbours share
        first = disk.empty(n, np.int8)
        for part in disk.parts(n):
            first[part] = 0
        for part in disk.parts(n):
            first[rank[part]] = 1
        dense, count = disk.empty(n), 0
        for part in disk.parts(n):
            dense[part] = np.cumsum(first[part]) + count - 1
            count = int(dense[part.stop - 1]) + 1
        between, at = disk.empty(count, np.int32), 0
        for part in disk.parts(n):
            v = apart[part][first[part] == 1]
            between[at : at + len(v)] = v
            at += len(v)
        self.apart = Least(disk, between)
        names = disk.empty(n)
        for part in disk.parts(n):
            names[part] = dense[rank[part]]
        # ranks of the cuts, and what neighbouring ones share
        above = disk.empty(n, np.int32)
        if count == n:
            order = disk.empty(n)
            for part in disk.parts(n):
                order[names[part]] = np.arange(part.start, part.stop)
            for part in disk.parts(n):
                o = order[max(part.start - 1, 0) : part.stop]
                shared = self.shared(cuts[o[:-1]], cuts[o[1:]], between[part.stop - len(o) + 1 : part.stop].astype(np.int64))
                above[part.stop - len(shared) : part.stop] = np.minimum(shared, cap)
            above[0] = 0
            places = names
        else:
            order, lcp = Text(disk, names, cuts, self).sorted(None, cap)
            places = disk.empty(n)
            for part in disk.parts(n):
                places[order[part]] = np.arange(part.start, part.stop)
                above[part] = lcp[part]
        least = Least(disk, above)
        # every wanted suffix: its typed symbols up to the next cut, and that one's rank
        total = self.n if wanted is None else len(wanted)
        starts, upto, tie = disk.empty(total), disk.empty(total), disk.empty(total)
        for part in disk.parts(total):
            w = np.arange(part.start, part.stop) if wanted is None else np.asarray(wanted[part])
            nxt = np.minimum(np.searchsorted(cuts, w, side="right"), n - 1)
            starts[part], upto[part], tie[part] = w, np.maximum(cuts[nxt], w), places[nxt]
        rank, apart = self.sequences(starts, upto)
        queue = Queue(disk)
        for part in disk.parts(total):
            queue.push(rank[part], tie[part], np.arange(part.start, part.stop))
        out, lcp, at = disk.empty(total), disk.empty(total, np.int32), 0
        before = None
        for r, t, idx in queue.pop():
            i, e = np.asarray(starts[idx]), np.asarray(upto[idx])
            out[at : at + len(i)] = i
            if before is None:
                before = (r[:1] - 1, t[:1], i[:1])
            r0, t0, i0 = (np.concatenate([x, y[:-1]]) for x, y in zip(before, (r, t, i), strict=True))
            got = np.zeros(len(i), dtype=np.int64)
            parts_ = np.flatnonzero((r != r0) & (r > 0))
            if len(parts_):
                got[parts_] = self.shared(i0[parts_], i[parts_], apart[r[parts_]].astype(np.int64))
            same = np.flatnonzero(r == r0)
            if len(same):
                up = self.first_text(e[same]) - self.first_text(i[same])
                tied = np.zeros(len(same), dtype=np.int64)
                go = np.flatnonzero(t0[same] < t[same])
                tied[go] = least.of(t0[same][go] + 1, t[same][go])
                got[same] = up + tied
            lcp[at : at + len(i)] = np.minimum(got, cap)
            before = (r[-1:], t[-1:], i[-1:])
            at += len(i)
        return out, lcp


def sorted_suffixes(text: np.ndarray, wanted: np.ndarray | None, cap: int, tuples: int) -> tuple[np.ndarray, np.ndarray]:
    """(start positions, all or the wanted ones, in the order of their suffixes; symbols shared with the one before).

    text: integers, the last one the single least; may be mapped from a file. tuples: how many a queue holds in
    memory; longer arrays are files, and the two results are such files then and go with the caller's references.
    """
    with tempfile.TemporaryDirectory(prefix="sl_sort_") as folder:
        return Text(Disk(tuples, folder), text).sorted(wanted, cap)
