"""A compressed FM-index over short sequences of words, in numpy.

The sequences are joined with distinct separators and their suffixes sorted; the Burrows-Wheeler transform is held as a
wavelet matrix of packed bits with counts by block. Backward search runs over many patterns at once. Runs of ``width`` words
are the unit of matching: an interval that has grown beyond them is widened again to all suffixes that share them.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector: 64 bits to a word and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        here = symbols
        for bit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            ones = (here >> bit & 1).astype(bool)
            zeros = int(len(here) - ones.sum())
            self.levels.append((bit, Bits(ones), zeros))
            here = np.concatenate([here[~ones], here[ones]])

    def descend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ends of [low, high) after sorting by symbol, counted within all places."""
        n = len(low)
        ends = np.concatenate([low, high])
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            one = np.concatenate([one, one])
            ones = bits.ones(ends)
            ends = np.where(one, zeros + ones, ends - ones)
        return ends[:n], ends[n:]


def sort_suffixes(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of all suffixes, their ranks by the first 8 symbols, and how often was sorted. The last symbol is unique."""
    n, rank8, rounds = len(ranks), None, 0
    here, length = ranks.astype(np.int64), 1
    while True:
        later = np.zeros(n, dtype=np.int64)
        if length < n:
            later[:-length] = here[length:] + 1
        key = here * (int(here.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[0] = 0
        np.cumsum(key[order][1:] != key[order][:-1], out=new[1:])
        here = np.empty(n, dtype=np.int64)
        here[order] = new
        length, rounds = 2 * length, rounds + 1
        if length == 8:
            rank8 = here.copy()
        if new[-1] == n - 1:
            return order, rank8 if rank8 is not None else here, rounds


class FMIndex:
    """Over sequences (words end to end, offsets) with a value each; ``least`` values are those of all places of a run."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, values: np.ndarray, width: int):
        self.width, count, sizes = width, len(offsets) - 1, np.diff(offsets)
        self.alphabet = np.unique(words)
        codes = np.searchsorted(self.alphabet, words)
        # separators sort before words, and by place among each other, so that no two suffixes are equal
        total = len(words) + count
        text = np.empty(total, dtype=np.int64)
        owner = np.repeat(np.arange(count), sizes)
        text[np.arange(len(words)) + owner] = codes + count
        text[offsets[1:] + np.arange(count)] = np.arange(count)
        order, rank8, _ = sort_suffixes(text)
        symbols = np.where(text >= count, text - count + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1))])
        self.tree = WaveletMatrix(symbols[order - 1], len(self.alphabet) + 1)
        # places of each symbol in the matrix's last order
        ends = np.arange(len(self.alphabet) + 1)
        self.base, _ = self.tree.descend(ends, np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends), dtype=np.int64))
        self.total = total
        # runs of width words: equal at the first 8 words and at the last 8
        second = np.minimum(order + width - 8, total - 1) if width > 8 else order
        a, b = rank8[order], rank8[second]
        new = np.ones(total, dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.run_of = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.run_start, self.run_end = starts, np.append(starts[1:], total)
        value_at = values[np.searchsorted(offsets[1:] + np.arange(count), np.arange(total), side="left")]
        self.least = np.minimum.reduceat(value_at[order], starts)

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol (1 and up; 0 is in no pattern) put before them."""
        a, b = self.tree.descend(code, low, high)
        move = self.first[code] - self.base[code]
        return a + move, b + move

    def runs(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each run of ``width`` words of each sequence, the interval's run in the index, -1 without one.

        Returns (runs end to end, offsets). Backward search goes through a sequence once: after ``width`` words each further
        one extends the interval, which is then widened to the run. Where a word has no extension, the rest of that
        sequence is searched run by run.
        """
        width, sizes = self.width, np.diff(offsets)
        n_runs = np.maximum(sizes - width + 1, 0)
        starts = np.concatenate([[0], np.cumsum(n_runs)])
        out = np.full(starts[-1], -1, dtype=np.int64)
        codes = np.minimum(np.searchsorted(self.alphabet, words), max(len(self.alphabet) - 1, 0))
        codes = np.where(self.alphabet[codes] == words, codes + 1, 0) if len(self.alphabet) else np.zeros(len(words), dtype=np.int64)
        rows = np.flatnonzero(n_runs)
        rows = rows[np.argsort(-sizes[rows], kind="stable")]
        low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), self.total, dtype=np.int64)
        alive, lengths = np.ones(len(rows), dtype=bool), sizes[rows]
        again: list[np.ndarray] = []
        for t in range(int(lengths[0]) if len(rows) else 0):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # sequences longer than t
            use = np.flatnonzero(alive[:n])
            if not len(use):
                break
            place = lengths[use] - 1 - t
            code = codes[offsets[rows[use]] + place]
            a, b = self.step(code, low[use], high[use])
            good = (code > 0) & (a < b)
            if not good.all():
                lost = use[~good]
                alive[lost] = False
                # runs whose last word has not been passed by a hit yet: all at or before this place
                for r, p in zip(lost, place[~good]):
                    upto = min(p, lengths[r] - width)
                    again.append(np.stack([np.full(upto + 1, rows[r]), np.arange(upto + 1)]))
                use, a, b, place = use[good], a[good], b[good], place[good]
            if t + 1 >= width:
                run = self.run_of[a]
                out[starts[rows[use]] + place] = run
                a, b = self.run_start[run], self.run_end[run]
            low[use], high[use] = a, b
        if again:
            row, place = np.concatenate(again, axis=1)
            out[starts[row] + place] = self._one_by_one(codes, offsets[row] + place)
        return out, starts

    def _one_by_one(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.total, dtype=np.int64)
        out, use = np.full(len(at), -1, dtype=np.int64), np.arange(len(at))
        for t in range(self.width - 1, -1, -1):
            code = codes[at[use] + t]
            a, b = self.step(code, low[use], high[use])
            good = (code > 0) & (a < b)
            use = use[good]
            low[use], high[use] = a[good], b[good]
        out[use] = self.run_of[low[use]]
        return out
