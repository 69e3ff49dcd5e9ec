"""Word n-grams of a batch interned in an open-addressed NumPy table.

Words are interned by XXH64 with linear probing: all n-grams of a batch look at their slot at once, those that meet an
empty slot claim it, those that meet their own key are compared byte by byte, and the others go on to the next slot.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Primes of the public XXH64 definition (fixed values).
PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
#: Slices shorter than this are hashed and compared as four 64-bit lanes, longer ones one by one.
SHORT = 32
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def lanes_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 32 bytes of each slice as four little-endian lanes, zeros behind its end."""
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    whole = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros((4, len(starts)), np.uint64)
    for k in range(4):
        left = np.clip(sizes - 8 * k, 0, 8)
        own = np.flatnonzero(left)
        if len(own):
            out[k, own] = np.ascontiguousarray(whole[starts[own] + 8 * k]).view("<u8").ravel() & _MASKS[left[own]]
    return out


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lanes: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of every slice of data."""
    p1, p2, p3, p4, p5 = PRIMES
    length = sizes.astype(np.uint64)
    h = np.uint64(seed) + p5 + length
    for k in range(3):
        own = sizes >= 8 * (k + 1)
        if own.any():
            h = np.where(own, _turn(h ^ (_turn(lanes[k] * p2, 31) * p1), 27) * p1 + p4, h)
    lane, at = lanes[np.minimum(sizes // 8, 3), np.arange(len(sizes))], sizes % 8
    half = at >= 4
    h = np.where(half, _turn(h ^ ((lane & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3, h)
    for k in range(3):
        byte = (lane >> np.where(half, 32 + 8 * k, 8 * k).astype(np.uint64)) & np.uint64(0xFF)
        h = np.where(at % 4 > k, _turn(h ^ (byte * p5), 11) * p1, h)
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes >= SHORT).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), seed)
    return h


class SlotTable:
    """Distinct slices of one batch. slot: that of each occurrence; owner: an occurrence for each slot in use; count: how many."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        n = len(starts)
        lanes = lanes_of(data, starts, sizes)
        self.hashes = xxh64(data, starts, sizes, lanes)
        room = 16
        while room < 2 * n:
            room *= 2
        owner = np.full(room, -1, np.int64)
        slot = (self.hashes & np.uint64(room - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = slot[left]
            empty = owner[at] < 0
            owner[at[empty][::-1]] = left[empty][::-1]  # of several that claim a slot, the first
            held = owner[at]
            same = (self.hashes[held] == self.hashes[left]) & (sizes[held] == sizes[left]) & (lanes[:, held] == lanes[:, left]).all(0)
            for i in np.flatnonzero(same & (sizes[left] >= SHORT) & (held != left)).tolist():
                one, other = (slice(int(starts[k]) + SHORT, int(starts[k] + sizes[k])) for k in (held[i], left[i]))
                same[i] = bool((data[one] == data[other]).all())
            left = left[~same]
            slot[left] = (slot[left] + 1) & (room - 1)
        used = np.flatnonzero(owner >= 0)
        place = np.empty(room, np.int64)
        place[used] = np.arange(len(used))
        self.slot, self.owner = place[slot], owner[used]
        self.count = np.bincount(self.slot, minlength=len(used))
