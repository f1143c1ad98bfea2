"""FM-index over sequences of words: suffix order, packed wavelet matrix, backward search.

Suffixes are sorted to a bounded depth, which is all that patterns of bounded length need.
The index answers, for many of its sequences streamed at once, which group of equal windows
each of their windows falls into: the match is extended to the left by backward search and
cut back at its right end, so it never grows beyond the window.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Counts of a symbol before a place, from packed bits: one bit of the symbol a level, highest first."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.bits = max(1, (alphabet - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(alphabet)
        self.start = self._down(every, np.zeros(alphabet, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for step, level in enumerate(range(self.bits - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[step][word] + np.bitwise_count(self.words[step][word] & below)
            at = np.where((symbols >> level) & 1, self.zeros[step] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbols, at) - self.start[symbols]


class FmIndex:
    """Index of sequences of symbols 1, 2, ...; 0 ends each sequence. ``window`` is the length of the patterns."""

    def __init__(self, sequences: list[np.ndarray], alphabet: int, window: int) -> None:
        zero = np.zeros(1, np.int64)
        text = np.concatenate([p for s in sequences for p in (s, zero)])
        n = len(text)
        self.window = window
        self.owner = np.repeat(np.arange(len(sequences)), [len(s) + 1 for s in sequences])
        rank, depth, kept = text, 1, {}
        while depth < window:
            kept[depth] = rank
            follow = np.zeros(n, np.int64)
            follow[: n - depth] = rank[depth:] + 1
            rank = np.unique(rank * (n + 2) + follow, return_inverse=True)[1]
            depth *= 2
        order = np.argsort(rank, kind="stable")
        self.suffixes = order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.wavelet = Wavelet(text[order - 1], alphabet)
        # Places of the suffix order where the first window, and the first window less one symbol, differ from the one before.
        self.group = self._groups(kept, order, window)
        self.low, self.high = self._bounds(self._groups(kept, order, window - 1))

    @staticmethod
    def _groups(kept: dict[int, np.ndarray], order: np.ndarray, length: int) -> np.ndarray:
        """Number of the group of suffixes that agree on ``length`` symbols, by two overlapping ranks."""
        half = max(d for d in kept if d <= length)
        rank = kept[half]
        late = np.full(len(rank), -1, np.int64)
        late[: len(rank) - (length - half)] = rank[length - half :]
        a, b = rank[order], late[order]
        return np.cumsum(np.append(False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))

    @staticmethod
    def _bounds(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        stops = np.append(starts[1:], len(group))
        return starts[group], stops[group]

    def windows(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each sequence, of a window or more, the place in the suffix order where each of its windows' group begins.

        All sequences step together from their right ends. They must be ones that the index
        holds, so a match of a whole window is never lost on the way.
        """
        length = np.array([len(s) for s in sequences])
        start = np.concatenate([[0], np.cumsum(length)])[:-1]
        flat = np.concatenate(sequences)
        low, high = np.zeros(len(sequences), np.int64), np.full(len(sequences), len(self.suffixes), np.int64)
        found = np.full(len(flat), -1, np.int64)
        order = np.argsort(-length, kind="stable")
        for step in range(int(length.max(initial=0))):
            live = order[: np.searchsorted(-length[order], -step)]
            place = start[live] + length[live] - 1 - step
            lo, hi = low[live], high[live]
            if step >= self.window:
                # Forget the right end: all suffixes that agree on one symbol less.
                lo, hi = self.low[lo], self.high[lo]
            symbol = flat[place]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.first[symbol], 2)
            lo, hi = both[: len(live)], both[len(live) :]
            low[live], high[live] = lo, hi
            if step >= self.window - 1:
                found[place] = lo
        return [found[a : a + n - self.window + 1] for a, n in zip(start, length, strict=True)]
