"""A compressed FM-index over sequences of words, searched backward for many patterns at once.

The text is several segments of word codes. Its Burrows-Wheeler transform is held in a wavelet matrix: one bit vector
for each bit of a code, packed 64 to a word, with a count before each of these. A backward step narrows a whole array
of suffix intervals by one word each. Of the suffix order itself only the rows are kept at which the first words change:
a packed bit for each row, and their numbers.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        low = self.words[at] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE)
        return self.before[at] + np.bitwise_count(low).astype(np.int64)


class WaveletMatrix:
    def __init__(self, codes: np.ndarray, depth: int):
        self.levels: list[Bits] = []
        for level in range(depth - 1, -1, -1):
            bits = (codes >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            codes = np.concatenate([codes[bits == 0], codes[bits == 1]])
        self.depth = depth

    def rank(self, codes: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where codes' occurrences before i end in the last level; differences of it count occurrences."""
        for level, bits in enumerate(self.levels):
            one = (codes >> (self.depth - 1 - level) & 1).astype(bool)
            r = bits.rank1(i)
            i = np.where(one, bits.zeros + r, i - r)
        return i


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each a group number shared by those that start with the same `depth` words.

    codes: no two suffixes may be equal, and the last code must differ from all others (separators are distinct).
    Prefix doubling; the group number comes from the ranks of the largest power of two within depth.
    """
    n = len(codes)
    rank = codes.astype(np.int64)
    width, group, order = 1, None, None
    while True:
        if width * 2 > depth and group is None:
            group = rank.copy(), width
        shifted = np.zeros(n, np.int64)
        if width < n:
            shifted[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + shifted if width > 1 else rank * (int(rank.max()) + 2) + shifted
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 and group is not None:
            break
    low, width = group
    shift = depth - width
    tail = np.full(n, -1, np.int64)
    tail[: n - shift] = low[shift:] if shift else low
    a, b = low[order], tail[order]
    change = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return order, np.cumsum(change) - 1


class FMIndex:
    """words: the segments' words, one after another (any integers); lengths: of the segments; depth: the threshold."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int):
        self.depth = depth
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        n, m = len(words), len(lengths)
        ends = np.cumsum(lengths)
        #: where each segment's words start in the text, in which a separator follows each segment
        self.starts = ends - lengths + np.arange(m)
        place = np.arange(n) + np.repeat(np.arange(m), lengths)
        text = np.empty(n + m, np.int64)
        text[place] = codes + m
        text[ends + np.arange(m)] = np.arange(m)[::-1]  # distinct separators, the last one smallest
        order, group = suffix_order(text, depth)
        size = n + m
        #: suffix rows that share their first `depth` words: a bit for the first row of each group, and those rows
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        self.opens = Bits(opens)
        self.group_start = np.append(np.flatnonzero(opens), size).astype(np.uint32 if size < 1 << 32 else np.int64)
        last = text[order - 1]
        coded = np.where(last >= m, last - m + 1, 0)
        self.wavelet = WaveletMatrix(coded, max(1, int(len(self.vocabulary)).bit_length()))
        counts = np.bincount(codes, minlength=len(self.vocabulary))
        self.first = m + np.concatenate([[0], np.cumsum(counts)])[:-1]  # first row of each code
        all_codes = np.arange(1, len(self.vocabulary) + 1)
        self.base = self.wavelet.rank(all_codes, np.zeros(len(all_codes), np.int64))
        self.size = size

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of words, -1 for words that the text doesn't have."""
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at, -1)

    def step(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front; empty if that pattern doesn't occur."""
        known = np.maximum(code, 0)
        both = self.wavelet.rank(np.concatenate([known, known]) + 1, np.concatenate([lo, hi]))
        shift = self.first[known] - self.base[known]
        n = len(code)
        lo, hi = both[:n] + shift, both[n:] + shift
        return lo, np.where(code >= 0, hi, lo)

    def matches(self, words: np.ndarray, lengths: np.ndarray):
        """Streams documents through the index from their ends: (document, position, group) of every position from
        which at least `depth` words match the text. Matching statistics are cut off at depth, as longer matches
        decide nothing: after each step the interval widens to all rows that share its first `depth` words.
        """
        codes = self.codes(words)
        ends = np.cumsum(lengths)
        begin = ends - lengths
        doc = np.flatnonzero(lengths > 0)
        at = ends[doc]
        lo, hi = np.zeros(len(doc), np.int64), np.full(len(doc), self.size, np.int64)
        have = np.zeros(len(doc), np.int64)
        found = []
        while len(doc):
            at = at - 1
            nlo, nhi = self.step(codes[at], lo, hi)
            miss = np.flatnonzero((nhi <= nlo) & (have > 0))
            if len(miss):
                # the longer pattern doesn't occur: drop words at its end until it does
                nlo[miss], nhi[miss], have[miss] = self._shorter(codes, at[miss], have[miss])
                have[miss] -= 1  # counted below
            empty = nhi <= nlo
            have = np.where(empty, 0, np.minimum(have + 1, self.depth))
            lo, hi = np.where(empty, 0, nlo), np.where(empty, self.size, nhi)
            full = have >= self.depth
            if full.any():
                g = self.opens.rank1(lo[full] + 1) - 1
                lo[full], hi[full] = self.group_start[g], self.group_start[g + 1]  # as int64
                found.append((doc[full], at[full] - begin[doc[full]], g))
            going = at > begin[doc]
            doc, at, lo, hi, have = doc[going], at[going], lo[going], hi[going], have[going]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _shorter(self, codes, at, have):
        """Longest match of at most `have` words (of have + 1 there is none) from each position: interval and length."""
        lo, hi, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        # a match of k words from a position implies one of k - 1: halve
        low, high = np.zeros(len(at), np.int64), have.copy()
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo] + 1) // 2
            a, b = self._search(codes, at[todo], mid)
            ok = b > a
            hit = todo[ok]
            low[hit], lo[hit], hi[hit], size[hit] = mid[ok], a[ok], b[ok], mid[ok]
            high[todo[~ok]] = mid[~ok] - 1
        return lo, hi, size

    def _search(self, codes, at, n):
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.size, np.int64)
        for k in range(int(n.max()) - 1, -1, -1):
            on = np.flatnonzero((n > k) & (hi > lo))
            if len(on):
                lo[on], hi[on] = self.step(codes[at[on] + k], lo[on], hi[on])
        return lo, hi
