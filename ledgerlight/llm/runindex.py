"""Run-length index of a set of strings: a run-compressed Burrows-Wheeler transform with samples at run ends.

The index holds one entry for each run of equal letters, so copies cost next to nothing:
where the run begins, where its first row goes by the LF step, and the match length there.
``stream`` walks all strings backwards at once and carries the matching statistics: from a
row to the next the length of the match with the row above grows by one, unless the row is
the first of its run; then the sample says it.
"""

from __future__ import annotations

import numpy as np

#: Places of one index: two ranks and a place share 63 bits.
PLACE_BITS = 21


class RunIndex:
    """``texts``: byte strings; every one gets its own terminator, smaller than any byte, ordered as given."""

    def __init__(self, texts: list[bytes], depth: int):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.depth, self.m = depth, len(texts)
        symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
        ends = np.cumsum(self.lengths + 1) - 1
        symbols[ends] = 0
        self.n = n = len(symbols)
        rest = np.repeat(ends, self.lengths + 1) - np.arange(n)  # symbols before the terminator
        levels, order = self._sorted(symbols, rest, n)
        before = np.where(order > 0, symbols[order - 1], 0)
        self.starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        letters = before[self.starts]
        sizes = np.diff(np.concatenate((self.starts, [n])))
        by_letter = np.argsort(letters, kind="stable")
        runs = sizes[by_letter]
        self.goes_to = np.empty(len(self.starts), np.int64)
        self.goes_to[by_letter] = np.cumsum(runs) - runs  # LF of a run's first row: rows of smaller letters, and of this one in earlier runs
        self.match = np.zeros(len(self.starts), np.int64)  # of that row with the one above, ``depth`` at most
        inner = np.flatnonzero((letters > 0) & (self.goes_to > 0))
        to = self.goes_to[inner]
        self.match[inner] = self._common(levels, symbols, rest, order[to - 1], order[to])

    def _common(self, levels, symbols, rest, a, b) -> np.ndarray:
        """Lengths of the common beginnings of suffixes, by ranks of falling prefix lengths, then single symbols."""
        got, last = np.zeros(len(a), np.int64), self.n - 1
        for h, rank in (*reversed(levels), *[(1, symbols)] * 4):
            got += h * (rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)])
        return np.minimum(np.minimum(got, self.depth), np.minimum(rest[a], rest[b]))

    def _sorted(self, symbols: np.ndarray, rest: np.ndarray, n: int):
        """(length, ranks of all prefixes of that length) for doubling lengths, and all suffixes in order, equal ones by place.

        The place stands in the low bits of each key, so that sorting the keys alone gives
        the order.
        """
        most = int(self.lengths.max(initial=0)) + 1
        bits = max(1, (n - 1).bit_length())
        if bits > PLACE_BITS:
            raise ValueError(f"more than {1 << PLACE_BITS} symbols in one index")
        place = np.arange(n)
        key = np.zeros(n, np.int64)
        first = max(1, min(5, (63 - bits) // 9))  # symbols of 9 bits that fit above a place
        for j in range(first):
            part = np.zeros(n, np.int64)
            part[: n - j] = symbols[j:]
            part[rest < j] = 0
            key = key << 9 | part
        h, levels = first, []
        while True:
            s = np.sort(key << bits | place)
            order = s & ((1 << bits) - 1)
            s >>= bits
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]).astype(np.int64))))
            levels.append((h, rank))
            undecided = (s[1:] == s[:-1]) & (rest[order[1:]] >= h)  # equal so far, and not yet at their ends
            if h >= most or not undecided.any():
                return levels, order
            further = np.zeros(n, np.int64)
            further[: n - h] = rank[h:]
            further[rest < h] = 0
            key, h = rank << bits | further, 2 * h

    def stream(self):
        """(group, string, start) arrays for all places whose next ``depth`` bytes stand more than once."""
        order = np.argsort(-self.lengths, kind="stable")
        lengths = self.lengths[order]
        rows, match = order.copy(), np.zeros(self.m, np.int64)  # the terminators are the first rows, in order of the strings
        above, string, start = np.zeros(self.n + 1, bool), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for t in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
            live = int(np.searchsorted(-lengths, -t, "right"))
            rows, match = rows[:live], match[:live]
            run = np.searchsorted(self.starts, rows, "right") - 1
            inside = rows - self.starts[run]
            rows, match = self.goes_to[run] + inside, np.where(inside > 0, match + 1, self.match[run])
            above[rows], string[rows], start[rows] = match >= self.depth, order[:live], lengths[:live] - t
        hit = np.flatnonzero(above[:-1] | above[1:])  # matches the row above or the one below
        return np.cumsum(~above[:-1])[hit], string[hit], start[hit]
