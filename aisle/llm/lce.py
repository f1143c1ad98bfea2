"""Longest common extensions of places of a sequence, by a difference cover.

Of every seven neighbouring places three are sampled, so that for any two places some shift
below seven brings both onto samples. Only the sampled suffixes are sorted. A query compares
words until that shift and then takes the minimum of the sampled suffixes' common prefixes
between their ranks, from a sparse table.
"""

from __future__ import annotations

import numpy as np

PERIOD = 7
#: Differences of these numbers modulo 7 are all of 0 to 6.
COVER = (0, 1, 3)
#: For the residue of the first place and the difference of both: the shift that brings both onto the cover.
SHIFT = np.array(
    [
        [next(k for k in range(PERIOD) if (i + k) % PERIOD in COVER and (i + d + k) % PERIOD in COVER) for d in range(PERIOD)]
        for i in range(PERIOD)
    ],
    np.int64,
)


class Extensions:
    """Common extensions to the right of the places of ``symbols``, numbers from 0 on.

    Symbols that occur once, such as the ends of texts that lie one after the other, are never passed.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.n = n
        # Ends that differ from each other and from all else, so that no comparison runs off the sequence.
        top = int(symbols.max(initial=0)) + 1
        self.text = np.concatenate([symbols.astype(np.int64), np.arange(top, top + PERIOD)])
        sampled = np.isin(np.arange(n + 1) % PERIOD, COVER)
        self.at = np.flatnonzero(sampled)
        self.slot = np.cumsum(sampled) - 1
        self._sort((top + PERIOD).bit_length())

    def _blocks(self, bits: int) -> np.ndarray:
        """Rank of the first seven symbols of each sampled suffix: how many have smaller ones."""
        each = 63 // bits
        keys = []
        for start in range(0, PERIOD, each):
            key = np.zeros(len(self.at), np.int64)
            for k in range(start, min(PERIOD, start + each)):
                key = (key << bits) | self.text[np.minimum(self.at + k, len(self.text) - 1)]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
        rank = np.empty(len(order), np.int64)
        rank[order] = self._starts(new)
        return rank

    @staticmethod
    def _starts(new: np.ndarray) -> np.ndarray:
        """Of sorted rows, where each row's group begins."""
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    def _sort(self, bits: int) -> None:
        rank, depth = self._blocks(bits), PERIOD
        levels = [(depth, rank)]
        while True:
            alike = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
            if not len(alike):
                break
            # Only suffixes that still look alike are sorted on, by the rank of what follows.
            after = self.at[alike] + depth
            follow = np.where(after <= self.n, rank[self.slot[np.minimum(after, self.n)]], -1)
            order = np.lexsort((follow, rank[alike]))
            own, follow = rank[alike][order], follow[order]
            group = np.append(True, own[1:] != own[:-1])
            part = group | np.append(True, follow[1:] != follow[:-1])
            rank = rank.copy()
            rank[alike[order]] = own + self._starts(part) - self._starts(group)
            depth *= 2
            levels.append((depth, rank))
        self.place = rank
        self._common(levels)

    def _common(self, levels: list[tuple[int, np.ndarray]]) -> None:
        """Common prefix of each sampled suffix with the one before it in order, and the sparse table of minima."""
        order = np.empty(len(self.place), np.int64)
        order[self.place] = np.arange(len(order))
        a, b = self.at[order[:-1]], self.at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for depth, rank in reversed(levels):
            x, y = a + common, b + common
            inside = np.maximum(x, y) <= self.n
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            common += depth * (inside & (rank[self.slot[x]] == rank[self.slot[y]]))
        left = np.arange(len(a))
        for _ in range(PERIOD):
            x, y = a[left] + common[left], b[left] + common[left]
            left = left[(np.maximum(x, y) < self.n) & (self.text[np.minimum(x, self.n)] == self.text[np.minimum(y, self.n)])]
            if not len(left):
                break
            common[left] += 1
        self.minima = [common]
        reach = 1
        while 2 * reach <= len(common):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-reach], last[reach:]))
            reach *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what follows alike at the different places ``i`` and ``j``."""
        shift = SHIFT[i % PERIOD, (j - i) % PERIOD]
        found = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for step in range(PERIOD):
            ready = shift[live] == step
            done = live[ready]
            if len(done):
                found[done] = step + self._sampled(i[done] + step, j[done] + step)
                live = live[~ready]
            x, y = i[live] + step, j[live] + step
            same = (np.maximum(x, y) < self.n) & (self.text[np.minimum(x, self.n)] == self.text[np.minimum(y, self.n)])
            found[live[~same]] = step
            live = live[same]
            if not len(live):
                break
        return found

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = self.place[self.slot[i]], self.place[self.slot[j]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        found = np.zeros(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            minima = self.minima[k]
            found[at] = np.minimum(minima[low[at]], minima[high[at] - (1 << k)])
        return found
