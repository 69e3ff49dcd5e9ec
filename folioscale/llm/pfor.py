"""Patched frame-of-reference blocks of token ids.

A file holds the ids of whole documents in a row. Each block of BLOCK ids stores its minimum, the width in bits that
the given share of its differences needs, those differences packed at that width, and an exception list with the place
and the whole difference of each larger one. The index holds the byte where each block starts.

    magic "PFR1", block ids u32, documents u64, ids u64, blocks u64
    documents: doc_id i64 (null: the flag is 1), null flag u8, ids u64 of each
    index: u64 for each block and one for the end
    blocks: minimum u32, width u8, exceptions u16, packed bits, places u16, differences u32
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

MAGIC = b"PFR1"
BLOCK = 128
_HEAD = 7


def _spread(out: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> None:
    """Put each row of bytes at its start."""
    if rows.size:
        out[starts[:, None] + np.arange(rows.shape[1])] = rows


def encode_blocks(ids: np.ndarray, block: int = BLOCK, share: float = 0.9) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes and where each starts, the end included. The last block is filled up with its last id."""
    n = len(ids)
    if not n:
        return b"", np.zeros(1, np.uint64)
    count = -(-n // block)
    padded = np.empty(count * block, np.int64)
    padded[:n] = ids
    padded[n:] = ids[-1]
    rows = padded.reshape(count, block)
    least = rows.min(1)
    diffs = rows - least[:, None]
    place = min(block - 1, max(0, int(np.ceil(share * block)) - 1))
    pivot = np.partition(diffs, place, axis=1)[:, place]
    widths = np.zeros(count, np.int64)
    for bit in range(32):
        widths[pivot >> bit > 0] = bit + 1
    large = diffs >> widths[:, None] > 0
    outliers = large.sum(1)
    packed = (block * widths + 7) // 8
    sizes = _HEAD + packed + 6 * outliers
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(starts[-1]), np.uint8)
    at = starts[:-1]
    head = np.empty((count, _HEAD), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(count, 4)
    head[:, 4] = widths
    head[:, 5:7] = outliers.astype("<u2").view(np.uint8).reshape(count, 2)
    _spread(out, at, head)
    for width in np.unique(widths):
        if width:
            own = np.flatnonzero(widths == width)
            low = (diffs[own] & (1 << int(width)) - 1).astype("<u4")
            bits = np.unpackbits(low.view(np.uint8).reshape(len(own), block, 4), axis=2, bitorder="little")[:, :, :width]
            _spread(out, at[own] + _HEAD, np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little"))
    if outliers.any():
        row, place_of = np.nonzero(large)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
        first = at[row] + _HEAD + packed[row]
        _spread(out, first + 2 * rank, place_of.astype("<u2").view(np.uint8).reshape(-1, 2))
        _spread(out, first + 2 * outliers[row] + 4 * rank, diffs[row, place_of].astype("<u4").view(np.uint8).reshape(-1, 4))
    return out.tobytes(), starts.astype(np.uint64)


def decode_blocks(data: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The first n ids of blocks that start at the given bytes (the end included)."""
    at = starts[:-1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint32)
    head = data[at[:, None] + np.arange(_HEAD)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel().astype(np.int64)
    widths = head[:, 4].astype(np.int64)
    outliers = np.ascontiguousarray(head[:, 5:7]).view("<u2").ravel().astype(np.int64)
    packed = (block * widths + 7) // 8
    diffs = np.zeros((len(at), block), np.int64)
    for width in np.unique(widths):
        if width:
            own = np.flatnonzero(widths == width)
            size = int((block * width + 7) // 8)
            # A value's bits lie in at most five bytes; the end of the row is filled up.
            rows = np.zeros((len(own), size + 5), np.uint8)
            rows[:, :size] = data[at[own][:, None] + _HEAD + np.arange(size)]
            bit = np.arange(block) * int(width)
            value = np.zeros((len(own), block), np.int64)
            for byte in range((int(width) + 14) // 8):
                value |= rows[:, (bit >> 3) + byte].astype(np.int64) << 8 * byte
            diffs[own] = value >> (bit & 7) & (1 << int(width)) - 1
    if outliers.any():
        row = np.repeat(np.arange(len(at)), outliers)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
        first = at[row] + _HEAD + packed[row]
        place = np.ascontiguousarray(data[(first + 2 * rank)[:, None] + np.arange(2)]).view("<u2").ravel()
        value = np.ascontiguousarray(data[(first + 2 * outliers[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        diffs[row, place] = value
    return (diffs + least[:, None]).ravel()[:n].astype(np.uint32)


def encode_file(doc_ids: Sequence[int | None], counts: Sequence[int], ids: np.ndarray, block: int = BLOCK, share: float = 0.9) -> bytes:
    data, starts = encode_blocks(ids, block, share)
    return b"".join(
        [
            MAGIC,
            struct.pack("<IQQQ", block, len(doc_ids), len(ids), len(starts) - 1),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.asarray(counts, "<u8").tobytes(),
            starts.astype("<u8").tobytes(),
            data,
        ]
    )


class TokenFile:
    """A token file: its documents, its block index, and ids of any range."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token file")
        self.block, docs, self.n_ids, blocks = struct.unpack_from("<IQQQ", payload, 4)
        raw = np.frombuffer(payload, np.uint8)
        at = 32
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at)
        at += 8 * docs
        self.nulls = raw[at : at + docs].astype(bool)
        at += docs
        self.counts = np.frombuffer(payload, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.starts = np.frombuffer(payload, "<u8", blocks + 1, at)
        self.data = raw[at + 8 * (blocks + 1) :]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids of a range; only the blocks that hold it are unpacked."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-end // self.block)
        found = decode_blocks(self.data, self.starts[first : last + 1], (last - first) * self.block, self.block)
        return found[start - first * self.block : end - first * self.block]
