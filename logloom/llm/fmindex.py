"""An FM-index over a bounded stretch of words: counts and places of phrases by backward search.

The stretch is a sequence of runs of word ids (from 1), each run closed by a 0. A suffix
ends with its run: the closing marks count as different symbols, smaller than any word,
in the order of their places. Suffixes are sorted by doubling prefixes, re-sorting only
those still tied; the Burrows-Wheeler transform is kept in a wavelet matrix of packed
bits, and every SAMPLE-th suffix position, and each run's first, is kept for locating.
"""

import numpy as np

SAMPLE = 16
# Three fields of this many bits share one 64-bit sort key.
BITS = 21
LONGEST = (1 << BITS) - 2


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes, sorted."""
    n = len(symbols)
    marks = symbols == 0
    closing = int(marks.sum())
    # Ranks from 1; a closing mark's rank is its number, final from the start.
    rank = symbols.astype(np.uint64) + np.uint64(closing)
    rank[marks] = np.arange(1, closing + 1, dtype=np.uint64)
    ids = np.unique(rank)
    first = np.searchsorted(ids, rank).astype(np.uint64)
    counts = np.bincount(first.astype(np.int64), minlength=len(ids))
    # The rank of a group is the row of its first member plus one.
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank = (begin[first.astype(np.int64)] + 1).astype(np.uint64)
    tied = np.flatnonzero(counts[first.astype(np.int64)] > 1).astype(np.uint64)
    shift, two, low = np.uint64(BITS), np.uint64(2 * BITS), np.uint64((1 << BITS) - 1)
    step = 1
    while len(tied):
        at = tied.astype(np.int64)
        # A tied suffix is longer than step, or it would have met its mark.
        key = (rank[at] << two) | (rank[at + step] << shift) | tied
        key.sort()
        place = (key & low).astype(np.int64)
        pair = key >> shift
        group = pair >> shift
        new_pair = np.ones(len(key), bool)
        new_pair[1:] = pair[1:] != pair[:-1]
        new_group = np.ones(len(key), bool)
        new_group[1:] = group[1:] != group[:-1]
        order = np.arange(len(key))
        group_start = np.maximum.accumulate(np.where(new_group, order, 0))
        pair_start = np.maximum.accumulate(np.where(new_pair, order, 0))
        rank[place] = group + (pair_start - group_start).astype(np.uint64)
        alone = new_pair & np.append(new_pair[1:], True)
        tied = place[~alone].astype(np.uint64)
        step *= 2
    out = np.empty(n, np.int64)
    out[rank.astype(np.int64) - 1] = np.arange(n)
    return out


class Bits:
    """A bit vector with ranks: packed words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        part = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WordIndex:
    """The FM-index of ``symbols`` (runs of ids from 1, each closed by 0), ids below ``alphabet``."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        if len(symbols) > LONGEST:
            raise ValueError(f"an index holds at most {LONGEST} words")
        self.n = len(symbols)
        order = suffix_order(symbols)
        transform = symbols[order - 1]  # before the first symbol stands the last run's mark
        counts = np.bincount(symbols, minlength=alphabet)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[int, Bits]] = []
        column = transform.astype(np.int32)
        for shift in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bits = (column >> shift) & 1 != 0
            self.levels.append((shift, Bits(bits)))
            column = np.concatenate([column[~bits], column[bits]])
        kept = (order % SAMPLE == 0) | (transform == 0)
        self.kept = Bits(kept)
        self.places = order[kept]

    def _before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the transform's first ``at`` rows."""
        start = np.zeros_like(at)
        for shift, bits in self.levels:
            one = (symbol >> shift) & 1 != 0
            a, b = bits.rank(start), bits.rank(at)
            start = np.where(one, bits.zeros + a, start - a)
            at = np.where(one, bits.zeros + b, at - b)
        return at - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each phrase (one a line, all of one length): from, to."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            c = symbol[alive]
            a = self.smaller[c] + self._before(c, low[alive])
            b = self.smaller[c] + self._before(c, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in ``rows``: back through the text to a kept place."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            known = self.kept.get(at)
            out[todo[known]] = self.places[self.kept.rank(at[known])] + steps
            todo, at = todo[~known], at[~known]
            if not len(todo):
                break
            # The symbol before each, and the row of the suffix that begins with it.
            symbol, start, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.copy()
            for shift, bits in self.levels:
                one = bits.get(place)
                symbol |= one.astype(np.int64) << shift
                a, b = bits.rank(start), bits.rank(place)
                start = np.where(one, bits.zeros + a, start - a)
                place = np.where(one, bits.zeros + b, place - b)
            at = self.smaller[symbol] + place - start
            steps += 1
        return out
