"""A bidirectional FM-index over a delimited vocabulary, searched for many words at once.

The text is ``$word$word$…$``. One index is built over the text and one over its reverse; a pattern is an interval of suffix
ranks in each, of equal size. Growing the pattern to the left narrows the interval of the text's index and shifts the other by
the number of smaller symbols; growing it to the right does the same with the roles exchanged. Symbol counts come from
a wavelet matrix with one running count per level, so a step for a whole array of patterns is a few array operations per level.
"""

from __future__ import annotations

import numpy as np

END, STOP, FIRST = 0, 1, 2  # the end of the text, the delimiter, the first letter's code


def _suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the suffixes in sorted order, by prefix doubling from as many symbols as fit a word. The last symbol is END alone."""
    n, width = len(text), 63 // bits
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(width, np.uint64)])
    for k in range(width):
        key = (key << np.uint64(bits)) | padded[k: k + n]
    while True:
        order = np.argsort(key)
        fresh = np.empty(n, bool)
        fresh[:1] = True
        ranked = key[order]
        fresh[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh, dtype=np.uint64)
        if fresh.all():
            return order
        after = np.zeros(n, np.uint64)
        if width < n:
            after[: n - width] = rank[width:]
        key = rank * np.uint64(n + 1) + after
        width *= 2


class _Wavelet:
    """Counts of symbols before a place, for arrays of places."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        self.total = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))]).astype(np.int32)
        for level in reversed(range(bits)):
            bit = (symbols >> level & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(np.int32(len(symbols) - ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.begin = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int32))

    def _down(self, symbol, place):
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            before = ones[place]
            place = np.where(symbol >> (self.bits - 1 - level) & 1, zeros + before, place - before)
        return place

    def step(self, symbol, low, high):
        """Of [low, high): rank of the first, size, and number of smaller symbols, for the given symbols."""
        smaller = np.zeros(len(low), np.int32)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            smaller += np.where(bit, (high - b) - (low - a), 0)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return self.total[symbol] + low - self.begin[symbol], high - low, smaller

    def children(self, low, high):
        """All symbols in every [low, high): (place of the interval, symbol, rank of the first, size, number of smaller symbols)."""
        which, symbol, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int32)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[low], ones[high]
            left, right = (high - b) > (low - a), b > a
            smaller = np.concatenate([smaller[left], (smaller + (high - b) - (low - a))[right]])
            which = np.concatenate([which[left], which[right]])
            symbol = np.concatenate([symbol[left] * 2, symbol[right] * 2 + 1])
            low, high = np.concatenate([(low - a)[left], (zeros + a)[right]]), np.concatenate([(high - b)[left], (zeros + b)[right]])
        return which, symbol, self.total[symbol] + low - self.begin[symbol], high - low, smaller


class BidirectionalIndex:
    """Distinct words, none of them empty, as lists of code points side by side: ``points`` and the lengths."""

    def __init__(self, points: np.ndarray, lengths: np.ndarray):
        self.letters, codes = np.unique(points, return_inverse=True)
        self.bits = max(int(len(self.letters) + FIRST - 1).bit_length(), 1)
        self.lengths = lengths.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])  # places of the delimiters
        text = np.full(self.starts[-1] + 2, STOP, np.int64)
        text[np.arange(len(points)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = codes + FIRST
        text[-1] = END
        self.text = text
        self.order = _suffix_order(text, self.bits)
        back = np.concatenate([text[-2::-1], [END]])
        self._left = _Wavelet(text[self.order - 1], self.bits)
        self._right = _Wavelet(back[_suffix_order(back, self.bits) - 1], self.bits)

    def _grow(self, right: bool, symbol, fore, hind, size):
        """Patterns grown by one symbol each: intervals in the index of the text (fore) and of its reverse (hind)."""
        if right:
            rank, fewer, smaller = self._right.step(symbol, hind, hind + size)
            return fore + smaller, rank, fewer
        rank, fewer, smaller = self._left.step(symbol, fore, fore + size)
        return rank, hind + smaller, fewer

    def _all_grown(self, right: bool, fore, hind, size):
        if right:
            which, symbol, rank, fewer, smaller = self._right.children(hind, hind + size)
            return which, symbol, fore[which] + smaller, rank, fewer
        which, symbol, rank, fewer, smaller = self._left.children(fore, fore + size)
        return which, symbol, rank, hind[which] + smaller, fewer

    def one_error(self, asked: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """One search scheme: a half of every asked word is met without, the rest with exactly one error.

        Going right the first half and its delimiter are exact, going left the second half and its delimiter.
        """
        length = self.lengths[asked]
        half, sign = length // 2, 1 if right else -1
        stop = np.where(right, length + 1, 0)  # place of the far delimiter, counted from the near end of the text's word
        base = self.starts[asked]
        # the exact half
        at, until = np.where(right, 0, length + 1), np.where(right, half, half + 1)
        word = np.arange(len(asked))
        fore, hind = np.zeros((2, len(asked)), np.int32)
        size = np.full(len(asked), len(self.text), np.int32)
        for _ in range(int(np.abs(until - at).max(initial=-1)) + 1):
            go = (at - until) * sign <= 0
            fore[go], hind[go], size[go] = self._grow(right, self.text[base[go] + at[go]], fore[go], hind[go], size[go])
            at = at + np.where(go, sign, 0)
        # along the rest without an error so far; every step branches off all single errors
        branches = []
        while len(word):
            symbol, far = self.text[base[word] + at], at == stop[word]
            which, found, f, h, n = self._all_grown(right, fore, hind, size)
            letter = found >= FIRST
            other = letter & ~far[which] & (found != symbol[which])
            branches.append((word[which[other]], at[which[other]] + sign, f[other], h[other], n[other]))  # replaced
            branches.append((word[which[letter]], at[which[letter]], f[letter], h[letter], n[letter]))  # one more in the text
            near = ~far
            branches.append((word[near], at[near] + sign, fore[near], hind[near], size[near]))  # one less in the text
            match = (found == symbol[which]) & ~far[which]
            word, at, fore, hind, size = word[which[match]], at[which[match]] + sign, f[match], h[match], n[match]
        word, at, fore, hind, size = (np.concatenate(x) for x in zip(*branches)) if branches else (np.zeros(0, np.int64),) * 5
        # the rest after the error, up to the far delimiter
        left, right_side = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(word):
            fore, hind, size = self._grow(right, self.text[base[word] + at], fore, hind, size)
            live, done = size > 0, at == stop[word]
            hit = live & done
            left.append(asked[word[hit]])
            right_side.append(np.searchsorted(self.starts, self.order[fore[hit]], "right") - 1)
            go = live & ~done
            word, at, fore, hind, size = word[go], at[go] + sign, fore[go], hind[go], size[go]
        return np.concatenate(left), np.concatenate(right_side)

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked word, other word) for words that differ in one inserted, deleted or replaced code point, each pair once."""
        a, b = zip(*(self.one_error(asked, right) for right in (True, False)))
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(a * np.int64(len(self.lengths) + 1) + b)
        return pair // (len(self.lengths) + 1), pair % (len(self.lengths) + 1)
