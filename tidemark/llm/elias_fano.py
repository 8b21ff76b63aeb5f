"""Elias-Fano lists and an n-gram trie on top of them, in one memory-mapped buffer.

All queries take arrays: a step of a search is done for all asked values at once.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

LEVELS = 256


class Buffer:
    """Arrays one after the other in one buffer, for writing and for reading in the same order."""

    def __init__(self, raw: memoryview | None = None) -> None:
        self.raw, self.at, self.parts = raw, 0, []

    def put(self, array: np.ndarray) -> None:
        kind = array.dtype.str.encode().ljust(8)
        data = np.ascontiguousarray(array).tobytes()
        self.parts += [kind, len(array).to_bytes(8, "little"), data, b"\0" * (-len(data) % 8)]

    def take(self) -> np.ndarray:
        kind = bytes(self.raw[self.at : self.at + 8]).decode().strip()
        n = int.from_bytes(self.raw[self.at + 8 : self.at + 16], "little")
        out = np.frombuffer(self.raw, kind, n, self.at + 16)
        self.at += 16 + out.nbytes + -out.nbytes % 8
        return out

    def mapped(self) -> Buffer:
        """What was put, for reading from a memory-mapped file that has no name and goes when unused."""
        with tempfile.TemporaryFile() as file:
            file.writelines(self.parts)
            file.flush()
            size = file.tell()
            return Buffer(memoryview(mmap.mmap(file.fileno(), size, access=mmap.ACCESS_READ)))


def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) in each 64-bit word."""
    place = np.zeros(len(words), np.uint64)
    k = k.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = (words >> place) & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        over = k >= count
        k = k - np.where(over, count, 0)
        place = place + np.where(over, np.uint64(width), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    """A non-decreasing list of integers: low bits as they are, high bits in unary.

    Low parts are cut at whole bytes.  ``access`` selects set bits, ``search`` selects clear bits to
    find the elements with the same high part and then looks for the low part among them.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, shape: np.ndarray) -> None:
        self.low, self.high, self.ones = low, high, ones
        self.n, self.bits, self.top = (int(x) for x in shape)
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - ones

    @staticmethod
    def put(values: np.ndarray, to: Buffer) -> None:
        n, last = len(values), int(values[-1]) if len(values) else 0
        ratio = max(1, last // max(1, n))
        bits = -(-ratio.bit_length() // 8) * 8 if ratio > 4 else 0
        bits = min(bits, 32) if bits != 24 else 32
        low = (values & ((1 << bits) - 1)).astype(f"u{bits // 8}") if bits else np.empty(0, np.uint8)
        high = values >> bits
        top = int(high[-1]) if n else 0
        flags = np.zeros(-(-(n + top + 2) // 64) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        words = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
        for array in (low, words, ones, np.array([n, bits, top], np.int64)):
            to.put(array)

    @staticmethod
    def take(source: Buffer) -> EliasFano:
        return EliasFano(*(source.take() for _ in range(4)))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The elements at these places."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        high = word * 64 + _in_word(self.high[word], i - self.ones[word]) - i
        return high << self.bits | self.low[i] if self.bits else high

    def _clear(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th clear bit."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _in_word(~self.high[word], k - self.zeros[word])

    def search(self, values: np.ndarray) -> np.ndarray:
        """The place of the first element that is not less than each value, -1 where it is not equal."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = values >> self.bits
        inside = np.flatnonzero((values >= 0) & (high <= self.top))
        high = high[inside]
        end = self._clear(high) - high
        begin = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        begin[some] = self._clear(high[some] - 1) - high[some] + 1
        if self.bits:
            low = values[inside] & ((1 << self.bits) - 1)
            left, right = begin.copy(), end.copy()
            while True:
                open_ = left < right
                if not open_.any():
                    break
                middle = (left + right) >> 1
                less = self.low[np.minimum(middle, self.n - 1)] < low
                left = np.where(open_ & less, middle + 1, left)
                right = np.where(open_ & ~less, middle, right)
            there = (left < end) & (self.low[np.minimum(left, self.n - 1)] == low)
        else:
            left, there = begin, begin < end
        out[inside] = np.where(there, left, -1)
        return out


def _quantised(values: np.ndarray, to: Buffer) -> None:
    """Positive numbers as one byte each: the nearest of LEVELS steps between the extreme logarithms."""
    logs = np.log10(values) if len(values) else np.zeros(1)
    low, high = float(logs.min()), float(logs.max())
    step = (high - low) / (LEVELS - 1) or 1.0
    codes = np.rint((logs - low) / step).astype(np.uint8) if len(values) else np.empty(0, np.uint8)
    to.put(codes)
    to.put(10 ** (low + step * np.arange(LEVELS)))


class NgramTrie:
    """Words, bigrams and trigrams with quantised weights.

    A bigram is the offset of its word in the span of its context.  A trigram's last word is not given
    by its number but by its place among the successors of the word before, which are few (the
    context-relative form), as an offset in a span of that many.  Spans follow each other, so each
    level is one non-decreasing list, and a search in it finds the node in its context at once.
    """

    def __init__(self, source: Buffer) -> None:
        self.words = int(source.take()[0])
        self.one, self.one_book = source.take(), source.take()
        self.back_one, self.back_one_book = source.take(), source.take()
        self.pairs, self.begin = EliasFano.take(source), EliasFano.take(source)
        self.two, self.two_book = source.take(), source.take()
        self.back_two, self.back_two_book = source.take(), source.take()
        self.triples, self.span = EliasFano.take(source), EliasFano.take(source)
        self.three, self.three_book = source.take(), source.take()

    @staticmethod
    def build(one: np.ndarray, back_one: np.ndarray, pairs: np.ndarray, two: np.ndarray, back_two: np.ndarray,
              heads: np.ndarray, tails: np.ndarray, three: np.ndarray) -> NgramTrie:
        """A trie in a memory-mapped file.

        one, back_one: by word, its probability and the weight it gives as a context to the level below.
        pairs, two, back_two: (context, word) rows in order, with weights.  heads, tails, three: the
        numbers of each trigram's first and last bigram, in the order of (head, last word), with weights.
        """
        words, out = len(one), Buffer()
        out.put(np.array([words], np.int64))
        _quantised(one, out)
        _quantised(back_one, out)
        EliasFano.put(pairs[:, 0] * words + pairs[:, 1], out)
        begin = np.searchsorted(pairs[:, 0], np.arange(words + 1))
        EliasFano.put(begin, out)
        _quantised(two, out)
        _quantised(back_two, out)
        fan = np.diff(begin)[pairs[:, 1]]
        span = np.concatenate([[0], np.cumsum(fan)])
        EliasFano.put(span[heads] + tails - begin[pairs[tails, 0]], out)
        EliasFano.put(span, out)
        _quantised(three, out)
        return NgramTrie(out.mapped())

    def word(self, words: np.ndarray) -> np.ndarray:
        """Probabilities of words without context."""
        return self.one_book[self.one[words]]

    def bigrams(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Nodes of bigrams, -1 where there is none."""
        return self.pairs.search(contexts * self.words + words)

    def add_bigram(self, nodes: np.ndarray, contexts: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities after one word, from those without context."""
        p = below * self.back_one_book[self.back_one[contexts]]
        has = nodes >= 0
        p[has] += self.two_book[self.two[nodes[has]]]
        return p

    def add_trigram(self, heads: np.ndarray, tails: np.ndarray, middle: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities after two words, from those after one.

        heads, tails: the nodes of the first and the last bigram of each trigram; middle: the word both have.
        """
        p = below.copy()
        known = np.flatnonzero(heads >= 0)
        p[known] *= self.back_two_book[self.back_two[heads[known]]]
        known = known[tails[known] >= 0]
        place = tails[known] - self.begin.access(middle[known])
        found = self.triples.search(self.span.access(heads[known]) + place)
        has = found >= 0
        p[known[has]] += self.three_book[self.three[found[has]]]
        return p
