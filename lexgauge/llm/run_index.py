"""A run-length index: Burrows-Wheeler transform kept as runs, text positions sampled at the ends of each run."""

from __future__ import annotations

import numpy as np

BITS = 9  # of a symbol
PACK = 7  # symbols in a sort key


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys."""
    order = np.argsort(key)
    s = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _ahead(a: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros_like(a)
    if d < len(a):
        out[:-d] = a[d:]
    return out


class RunIndex:
    """Index of strings over symbols 1 to 511, laid end to end, each followed by a 0.

    The order of suffixes comes from prefix doubling that stops at a string's end; equal
    rests of strings keep the order of their positions.  What is kept is one entry a
    run: its symbol, its first row, where its rows map to, and the text positions
    of its first and last row.  Ranks of the doubling stay as a table of longest common
    extensions.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        text = text.astype(np.int64)
        ends = np.flatnonzero(text == 0)
        left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n) + 1  # symbols to the string's end, its 0 included
        key = np.zeros(n, np.int64)
        for j in range(PACK):
            key = (key << BITS) | np.where(left > j, _ahead(text, j) if j else text, 0)
        rank, depth, longest = _dense(key), PACK, int(left.max())
        self.steps = [(depth, rank.astype(np.int32))]
        while depth < longest:
            rank = _dense(rank * (n + 1) + np.where(left > depth, _ahead(rank, depth), 0))
            depth *= 2
            self.steps.append((depth, rank.astype(np.int32)))
        order = np.argsort(rank * n + np.arange(n))  # equal suffixes by position
        before = text[order - 1]  # the row of position 0 takes the last 0
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.text, self.size = text, n
        self.run_start, self.run_symbol = head, before[head]
        last = np.append(head[1:], n) - 1
        self.first_at, self.last_at = order[head], order[last]
        self.run_last = last
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        sizes = last - head + 1
        target = np.empty(len(head), np.int64)
        target[by_symbol] = np.concatenate([[0], np.cumsum(sizes[by_symbol])[:-1]])  # all symbols before the run's, then its earlier runs
        self.target = target
        self.ordered, self.order_key = by_symbol, self.run_symbol[by_symbol] * len(head) + by_symbol

    def extension(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols agree from positions p and q on, ``most`` of them at the most."""
        p, q, got, end = p.copy(), q.copy(), np.zeros(len(p), np.int64), self.size - 1
        for depth, rank in reversed(self.steps):
            same = (rank[np.minimum(p, end)] == rank[np.minimum(q, end)]) & (got < most)
            for a in (p, q, got):
                a += same * depth
        for _ in range(PACK - 1):
            same = (self.text[np.minimum(p, end)] == self.text[np.minimum(q, end)]) & (got < most)
            if not same.any():
                break
            for a in (p, q, got):
                a += same
        return np.minimum(got, most)

    def matching_statistics(self, patterns: np.ndarray, lengths: np.ndarray):
        """Stream patterns from their ends to their starts, all in step; yields (symbols from the end, rows, match lengths).

        ``patterns`` is a matrix aligned to the right, its rows in falling order of
        ``lengths``.  A row holds the place of its longest match: a row of the index and a text
        position.  A symbol that does not go before that match moves it to the nearest run of
        the symbol above or below, whichever sampled end agrees for longer.
        """
        runs, width = len(self.run_start), patterns.shape[1]
        row = np.zeros(len(patterns), np.int64)
        run = np.zeros(len(patterns), np.int64)
        at = np.full(len(patterns), self.first_at[0])
        length = np.zeros(len(patterns), np.int64)
        for t in range(width):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # rows of more than t symbols
            if not live:
                return
            c = patterns[:live, width - 1 - t].astype(np.int64)
            off = np.flatnonzero(self.run_symbol[run[:live]] != c)
            if len(off):
                want, here = c[off], run[off]
                i = np.searchsorted(self.order_key, want * runs + here)
                below, above = self.ordered[np.minimum(i, runs - 1)], self.ordered[np.maximum(i - 1, 0)]
                has_below = (i < runs) & (self.run_symbol[below] == want)
                has_above = (i > 0) & (self.run_symbol[above] == want)
                n_below = np.where(has_below, self.extension(at[off], self.first_at[below], length[off]), -1)
                n_above = np.where(has_above, self.extension(at[off], self.last_at[above], length[off]), -1)
                up = n_above > n_below
                found = has_below | has_above
                to = np.where(up, above, below)
                run[off] = np.where(found, to, 0)
                row[off] = np.where(found, np.where(up, self.run_last[above], self.run_start[below]), 0)
                at[off] = np.where(found, np.where(up, self.last_at[above], self.first_at[below]), self.first_at[0])
                length[off] = np.where(found, np.maximum(n_above, n_below), -1)
            go = length[:live] >= 0
            r = run[:live]
            row[:live] = np.where(go, self.target[r] + row[:live] - self.run_start[r], 0)
            at[:live] = np.where(go, at[:live] - 1, self.first_at[0])
            length[:live] += 1
            run[:live] = np.searchsorted(self.run_start, row[:live], side="right") - 1
            yield t, live, length[:live]
