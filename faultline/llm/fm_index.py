"""A compressed full-text index over sequences of word hashes, searched backward for many patterns at once.

The index holds the Burrows-Wheeler transform of the sequences in a wavelet tree: for each bit of a
symbol one packed bit vector with running counts, so that the occurrences of a symbol before a place
take one look-up a level. Searches, one for each pattern, advance together: a step extends every
pattern by one word to the left and narrows its interval of suffixes.

Each sequence has an owner (a number). An interval counts only while a suffix of a smaller owner lies in
it, which a table of minima over powers of two tells. Matching statistics of a text, the longest match that ends at
a place, are taken at the ends where a match of at least the wanted length may still add something.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence in order, by doubling the compared length until all differ."""
    n, rank, length = len(symbols), symbols.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - length)] = rank[length:] + 1
        key = rank * (int(rank.max()) + 2) + ahead if n else rank
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if n else rank
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if not n or fresh[-1] == n - 1:
            return order
        length *= 2


class WaveletTree:
    """Counts of symbols before places of a sequence."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n, self.levels = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        at = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (at >> level & 1).astype(bool)
            packed = np.zeros((self.n + 64) // 64 * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            at = np.concatenate([at[~bit], at[bit]])
        self.start = self.mapped(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def mapped(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the path of each symbol leads from a place of the top level."""
        for k in range(self.levels):
            word = places >> 6
            low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & low)
            places = np.where(symbols >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, places - ones)
        return places

    def counts(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before a place."""
        return self.mapped(symbols, places) - self.start[symbols]


class FMIndex:
    """The sequences words[at[k]:at[k + 1]], each with an owner."""

    def __init__(self, words: np.ndarray, at: np.ndarray, owners: np.ndarray):
        self.vocabulary, symbol = np.unique(words, return_inverse=True)
        m, n = len(at) - 1, len(words)
        ends = at[1:] + np.arange(m)  # each sequence is followed by a sign of its own
        text = np.empty(n + m, np.int64)
        body = np.ones(n + m, bool)
        body[ends] = False
        text[body] = symbol + m
        text[ends] = np.arange(m)
        order = suffix_order(text)
        self.n = n + m
        before = np.maximum(text[order - 1] - m + 1, 0)  # all end signs are symbol 0 here, which no pattern asks for
        self.tree = WaveletTree(before, len(self.vocabulary) + 1)
        self.first = m + np.concatenate([[-m], np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=len(self.vocabulary)))[:-1]])]).astype(np.int64)
        self.owners, rank = np.unique(owners, return_inverse=True)
        low = np.repeat(rank, np.diff(at) + 1)[order].astype(np.int32)
        self.low = [low]
        while 2 << (len(self.low) - 1) <= self.n:
            half = 1 << (len(self.low) - 1)
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place in owners of the smallest owner among suffixes lo to hi (not empty)."""
        power = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for p in np.unique(power):
            k = power == p
            out[k] = np.minimum(self.low[p][lo[k]], self.low[p][hi[k] - (1 << int(p))])
        return out

    def passages(self, words: np.ndarray, at: np.ndarray, owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of at least so many words in sequences of smaller owners, for the texts words[at[k]:at[k + 1]].

        Returns text, begin and end of each (within the text). They cover every window of that many words that a
        sequence of a smaller owner holds: after a match, the next end asked for is that of the first window beyond it.
        """
        place = np.searchsorted(self.vocabulary, words)
        known = place < len(self.vocabulary)
        known[known] = self.vocabulary[place[known]] == words[known]
        symbol = np.where(known, place + 1, 0)
        limit = np.searchsorted(self.owners, owners)
        live = np.flatnonzero(np.diff(at) >= least)
        start, right = at[live].astype(np.int64), at[live + 1].astype(np.int64)
        left, lo, hi = right.copy(), np.zeros(len(live), np.int64), np.full(len(live), self.n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            c = symbol[np.maximum(left - 1, 0)]
            counts = self.tree.counts(np.concatenate([c, c]), np.concatenate([lo, hi])) + self.first[np.concatenate([c, c])]
            new_lo, new_hi = counts[: len(c)], counts[len(c) :]
            grows = (left > start) & (c > 0) & (new_lo < new_hi)
            grows[grows] = self.smallest(new_lo[grows], new_hi[grows]) < limit[live[grows]]
            left, lo, hi = left - grows, np.where(grows, new_lo, lo), np.where(grows, new_hi, hi)
            ended = np.flatnonzero(~grows)
            if not len(ended):
                continue
            hit = right[ended] - left[ended] >= least
            e = ended[hit]
            found.append((live[e], left[e] - start[e], right[e] - start[e]))
            right[ended] = np.where(hit, left[ended] + least - 1, right[ended] - 1)
            left[ended], lo[ended], hi[ended] = right[ended], 0, self.n
            keep = right - start >= least
            if not keep.all():
                live, start, right, left, lo, hi = (x[keep] for x in (live, start, right, left, lo, hi))
        none = np.zeros(0, np.int64)
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return np.concatenate([none, *a]), np.concatenate([none, *b]), np.concatenate([none, *c])
