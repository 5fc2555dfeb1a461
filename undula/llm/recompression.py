"""Recompression: a run-length grammar over sequences of symbols, and extensions of equal stretches on it.

Two steps alternate. Block compression replaces every maximal stretch of one symbol by a symbol for (symbol,
length); pair compression splits the symbols in two classes and replaces every neighbouring pair (first class,
second class). Both decide by the symbols alone, so equal stretches are parsed alike but for their ends. Each
step is one level; levels end when every sequence is a single symbol, after a number of steps logarithmic in
the longest one.

An extension compares two places symbol by symbol. While both stand at the edge of their parents and agree,
they climb; a symbol that is not at the edge is consumed first, at most one symbol or block a level. Once they
differ they climb down again, consuming the children that still agree. All places of a call move together.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0  # stands before, between and after the sequences; never compressed
_MIX = 0x9E3779B97F4A7C15


def _second_class(symbols: np.ndarray, level: int) -> np.ndarray:
    """A pseudorandom class of each symbol, drawn anew at each level."""
    x = (symbols.astype(np.uint64) + np.uint64(level * _MIX % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0x94D049BB133111EB) >> np.uint64(61)) & np.uint64(1) == 1


def _named(a: np.ndarray, b: np.ndarray, free: int) -> tuple[np.ndarray, int]:
    """One new symbol from ``free`` on for each distinct (a, b), and the next free one."""
    pairs, name = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
    return free + name, free + len(pairs)


class Grammar:
    """The levels over ``symbols`` (int64, at least 0, separators at both ends and none side by side).

    ``symbols[h]``: the symbols of level h. ``first[h]``: for each of them its first child on level h - 1, and the
    number of those as a last entry. ``parent[h]``: for each symbol of level h its parent. ``blocks[h]``: whether
    level h came from block compression.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.first, self.parent, self.blocks = [symbols], [np.zeros(0, np.int64)], [], [False]
        sequences = int((symbols == SEPARATOR).sum()) - 1
        free, pairs = int(symbols.max()) + 1, 0
        while len(self.symbols[-1]) > 2 * sequences + 1:
            s = self.symbols[-1]
            head = np.concatenate(([True], s[1:] != s[:-1]))
            if not head.all():
                first = np.flatnonzero(head)
                size = np.diff(np.append(first, len(s)))
                up, many = s[first], size > 1
                up[many], free = _named(up[many], size[many], free)
                self._add(up, first, head, True)
                s = up
                if len(s) <= 2 * sequences + 1:
                    break
            pairs += 1
            second = _second_class(s, pairs)
            joined = ~second[:-1] & second[1:] & (s[:-1] != SEPARATOR) & (s[1:] != SEPARATOR)
            if not joined.any():
                continue
            head = np.concatenate(([True], ~joined))
            first = np.flatnonzero(head)
            up, two = s[first], joined[np.minimum(first, len(joined) - 1)] & (first < len(joined))
            up[two], free = _named(up[two], s[first[two] + 1], free)
            self._add(up, first, head, False)

    def _add(self, symbols: np.ndarray, first: np.ndarray, head: np.ndarray, block: bool) -> None:
        self.parent.append(np.cumsum(head) - 1)
        self.first.append(np.append(first, len(head)))
        self.symbols.append(symbols)
        self.blocks.append(block)

    def extension(self, i: np.ndarray, j: np.ndarray, way: int = 1) -> np.ndarray:
        """How many symbols from places ``i`` and ``j`` on (``way`` -1: before them) agree.

        Places are of the lowest level, i < j, and fewer apart than any sequence between them is long.
        """
        top = len(self.parent)
        a, b = (i.copy(), j.copy()) if way > 0 else (i - 1, j - 1)
        at = np.zeros(len(a), np.int64)  # the level on which a and b stand and differ
        live = np.arange(len(a))
        for h in range(top + 1):
            s = self.symbols[h]
            same = s[a[live]] == s[b[live]]
            at[live[~same]] = h
            live = live[same]
            if not len(live):
                break
            first, x, y = self.first[h + 1], a[live], b[live]
            p, q = self.parent[h][x], self.parent[h][y]
            if way > 0:
                left_x, left_y = first[p + 1] - x, first[q + 1] - y
                edge = (first[p] == x) & (first[q] == y)
            else:
                left_x, left_y = x - first[p] + 1, y - first[q] + 1
                edge = (first[p + 1] - 1 == x) & (first[q + 1] - 1 == y)
            odd = ~edge & (left_x != left_y)  # one block ends sooner: they differ behind it
            n = live[odd]
            step = way * np.minimum(left_x, left_y)[odd]
            a[n], b[n], at[n] = x[odd] + step, y[odd] + step, h
            a[live], b[live] = np.where(odd, a[live], np.where(edge, p, p + way)), np.where(odd, b[live], np.where(edge, q, q + way))
            live = live[~odd]
        for h in range(int(at.max(initial=0)), 0, -1):
            n = np.flatnonzero(at >= h)
            first, s, x, y = self.first[h], self.symbols[h - 1], a[n], b[n]
            p, q = (first[x], first[y]) if way > 0 else (first[x + 1] - 1, first[y + 1] - 1)
            same = s[p] == s[q]
            step = np.minimum(first[x + 1] - first[x], first[y + 1] - first[y]) if self.blocks[h] else 1
            a[n], b[n] = p + way * same * step, q + way * same * step
        return (a - i) * way if way > 0 else i - 1 - a
