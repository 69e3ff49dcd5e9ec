"""Elias-Fano sequences and the levels of an n-gram trie, as bytes that can be memory-mapped.

A sequence of n non-decreasing numbers below a bound keeps the low bits of each number packed, and the high bits in
unary: a one for each number, a zero for each step of the high part. Zeros up to each word of 64 bits are counted, so
the numbers that share a high part are found by two look-ups and a search among their low bits.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQQQ")  # numbers, low bits, words of high bits, words of low bits


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of width bits in a row, in words of 64 bits, and a word more."""
    words = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, values << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def _unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    at = at.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    mask = np.uint64((1 << width) - 1)
    return (low | high) & mask


def encode(values: np.ndarray, bound: int) -> bytes:
    """The bytes of a sorted array of unsigned numbers below bound."""
    values = values.astype(np.uint64)
    n = len(values)
    width = max(0, (bound // max(n, 1)).bit_length() - 1)
    width = min(width, 63)
    low = _pack(values & np.uint64((1 << width) - 1), width)
    high = (values >> np.uint64(width)).astype(np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    bits = np.zeros((size + 63) // 64 * 64 + 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))]).astype("<u8")
    return _HEAD.pack(n, width, len(words), len(low)) + words.tobytes() + zeros.tobytes() + low.astype("<u8").tobytes()


def _table() -> np.ndarray:
    """Place of the k-th one in each byte."""
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        ones = [i for i in range(8) if byte >> i & 1]
        table[byte, : len(ones)] = ones
    return table


_PLACE = _table()
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_FIVES, _THREES, _NIBBLES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def select(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each word of 64 bits: byte sums side by side, then a table."""
    one, two, four, eight = (np.uint64(x) for x in (1, 2, 4, 8))
    sums = bits - (bits >> one & _FIVES)
    sums = (sums & _THREES) + (sums >> two & _THREES)
    sums = ((sums + (sums >> four)) & _NIBBLES) * _EACH  # byte i: ones in the bytes up to it
    k = k.astype(np.uint64)
    byte = np.bitwise_count((k * _EACH | _TOP) - sums & _TOP).astype(np.uint64) * eight  # bytes that end at or before the k-th one
    left = k - (sums << eight >> byte & np.uint64(255))
    return byte.astype(np.int64) + _PLACE[(bits >> byte & np.uint64(255)).astype(np.int64), left.astype(np.int64)]


class Sequence:
    """A sequence in a buffer; its arrays are views of it."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.width, words, low = _HEAD.unpack_from(buffer, at)
        at += _HEAD.size
        self.high = np.frombuffer(buffer, "<u8", words, at)
        at += 8 * words
        self.zeros = np.frombuffer(buffer, "<u8", words + 1, at)
        at += 8 * (words + 1)
        self.low = np.frombuffer(buffer, "<u8", low, at)
        self.end = at + 8 * low
        self.last_high = int(self.zeros[-1]) - 1
        self.ones = np.arange(words + 1, dtype=np.int64) * 64 - self.zeros.astype(np.int64)

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """Place behind the k-th zero (counted from 0) in the high bits."""
        word = np.searchsorted(self.zeros, k.astype(np.uint64), side="right") - 1
        return word * 64 + select(~self.high[word], k - self.zeros[word].astype(np.int64)) + 1

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the first number not below each value, and whether it equals the value."""
        values = values.astype(np.uint64)
        high = np.minimum((values >> np.uint64(self.width)), np.uint64(self.last_high)).astype(np.int64)
        beyond = (values >> np.uint64(self.width)) > np.uint64(self.last_high)
        first = np.where(high > 0, self._after_zero(np.maximum(high - 1, 0)) - high, 0)
        last = self._after_zero(high) - high - 1
        first, last = np.minimum(first, self.n), np.minimum(last, self.n)
        target = values & np.uint64((1 << self.width) - 1)
        low, up = first.copy(), last.copy()
        open_ = np.flatnonzero(low < up)
        while len(open_):
            mid = (low[open_] + up[open_]) >> 1
            less = _unpack(self.low, mid, self.width) < target[open_]
            low[open_[less]] = mid[less] + 1
            up[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < up[open_]]
        found = np.zeros(len(values), bool)
        inside = (low < last) & ~beyond
        found[inside] = _unpack(self.low, low[inside], self.width) == target[inside]
        return np.where(beyond, self.n, low), found

    def get(self, rank: np.ndarray) -> np.ndarray:
        """The numbers of the given ranks."""
        rank = rank.astype(np.int64)
        word = np.searchsorted(self.ones, rank, side="right") - 1
        at = word * 64 + select(self.high[word], rank - self.ones[word])
        return (((at - rank).astype(np.uint64)) << np.uint64(self.width)) | _unpack(self.low, rank, self.width)
