"""An FM-index over a sequence of symbols: backward search by wavelet-matrix ranks, positions by sampled suffixes."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 separates runs; each 0 counts as a symbol of its own, in order of place."""
    n = len(text)
    gaps = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(gaps)
    key[gaps] = np.arange(len(gaps))
    order = np.argsort(key, kind="stable")
    step = 1
    while True:
        at = key[order]
        fresh = np.empty(n, bool)
        fresh[0] = True
        fresh[1:] = at[1:] != at[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step *= 2


class FMIndex:
    """Index of runs of positive symbols, each run followed by one 0; the text ends in a 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_order(text)
        self.n, self.sample = len(text), sample
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.bits = max(1, int(sigma).bit_length())
        self.ranks, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ranks[-1][-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])
        first = np.zeros(self.n, bool)  # a walk back never has to pass the start of a run
        first[1:] = text[:-1] == 0
        first[0] = True
        at = first[order] | (order % sample == 0)
        self.marked = np.concatenate([[0], np.cumsum(at)]).astype(np.int32)
        self.places = order[at].astype(np.int32)

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the BWT before each row."""
        low, rows = np.zeros(len(rows), np.int64), rows.astype(np.int64)
        for i, b in enumerate(range(self.bits - 1, -1, -1)):
            one, r = (symbols >> b) & 1 == 1, self.ranks[i]
            low = np.where(one, self.zeros[i] + r[low], low - r[low])
            rows = np.where(one, self.zeros[i] + r[rows], rows - r[rows])
        return rows - low

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(rows), np.int64), rows.astype(np.int64)
        for i in range(self.bits):
            r = self.ranks[i]
            one = r[rows + 1] - r[rows]
            out = out * 2 + one
            rows = np.where(one == 1, self.zeros[i] + r[rows], rows - r[rows])
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each phrase; phrases are rows padded on the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > j) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - j]
            for edge in (low, high):
                edge[live] = self.before[c] + self.rank(c, edge[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at these rows, by walking back to a sampled one."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        at, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(at):
            found = self.marked[rows + 1] > self.marked[rows]
            out[at[found]] = self.places[self.marked[rows[found]]] + steps
            at, rows = at[~found], rows[~found]
            c = self.symbol(rows)
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out
