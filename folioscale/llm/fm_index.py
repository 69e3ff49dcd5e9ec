"""A compressed FM-index of word sequences: Burrows-Wheeler transform in a code-shaped wavelet tree.

Words are numbers from 1 on; 0 ends a sequence. The transform is kept as a wavelet tree whose shape follows a prefix
code of the words' frequencies, so frequent words take few bits; rank is answered from 64-bit words and a running
count. Suffixes are sorted to a depth of DEPTH words, which is enough for patterns up to that length. Sequences weigh
as many occurrences as they stand for. Searches go backward over many sequences at once, each at its own place.
"""

from __future__ import annotations

import numpy as np

#: Words that suffixes are sorted by: each pass triples what a rank stands for.
PASSES = 4
DEPTH = 3**PASSES
#: Numbers that three of fit into 63 bits.
MOST = 1 << 21
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def _rank_of(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    sorted_keys = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], sorted_keys[1:] != sorted_keys[:-1]]))
    return rank


def sort_suffixes(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes by their first DEPTH words, and the ranks of all runs of 1, 3, 9, ... words on the way, but for the last."""
    ranks, step = [words.astype(np.int64)], 1
    for _ in range(PASSES):
        own = np.concatenate([ranks[-1], np.zeros(2 * step, np.int64)])
        n = len(words)
        keys = (own[:n] << 42) | (own[step : n + step] << 21) | own[2 * step : n + 2 * step]
        order = np.argsort(keys)
        step *= 3
        if step < DEPTH:
            ranks.append(_rank_of(keys, order))
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of the order shares with the one before it, up to DEPTH - 1; 0 for the first."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    one, other = order[1:], order[:-1]
    for level in range(len(ranks) - 1, -1, -1):
        own, size = np.concatenate([ranks[level], [-1]]), 3**level
        for _ in range(2):
            a, b = np.minimum(one + shared[1:], n), np.minimum(other + shared[1:], n)
            same = (own[a] == own[b]) & (a < n) & (b < n)
            shared[1:] += size * same
    return shared


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, -1 if there is none."""
    values = values.astype(np.int8)
    before = np.arange(-1, len(values) - 1, dtype=np.int32)
    left = np.flatnonzero(np.concatenate([[False], values[:-1] >= values[1:]])).astype(np.int32)
    before[left] = before[left - 1]
    while len(left):
        at = before[left]
        left = left[(at >= 0) & (values[at] >= values[left])]
        before[left] = before[before[left]]
    return before


class WaveletTree:
    """rank(word, place): how often a word stands before a place of the sequence."""

    def __init__(self, sequence: np.ndarray, n_words: int):
        n = len(sequence)
        often = np.bincount(sequence, minlength=n_words)
        used = often > 0
        size = np.zeros(n_words, np.int64)
        size[used] = np.maximum(1, np.ceil(np.log2(n / often[used])).astype(np.int64))
        depth = int(size.max()) if n else 0
        # Canonical code: shorter codes first, each behind the room that those before it take.
        order = np.flatnonzero(used)[np.argsort(size[used], kind="stable")]
        room = np.int64(1) << (depth - size[order])
        code = np.zeros(n_words, np.int64)
        code[order] = np.cumsum(room) - room
        self.size, self.code, self.depth, self.n = size.astype(np.int8), code.astype(np.int32), depth, n
        bits, offset, base, child = [], [], [], []
        code, size, own, nodes, at = self.code, self.size, sequence.astype(np.int32), 1, 0
        node = np.zeros(n, np.int32)
        first = 0
        for level in range(depth):
            bit = (code[own] >> (depth - 1 - level)) & 1
            ones = np.zeros(len(own) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            length = np.bincount(node, minlength=nodes).astype(np.int32)
            start = (np.cumsum(length) - length).astype(np.int32)
            offset.append(at + start)
            base.append(ones[start])
            bits.append(bit.astype(bool))
            at += len(own)
            n_ones = ones[start + length] - ones[start]
            # Stable within each node: zeros before ones.
            ones_before = ones[:-1] - ones[start][node]
            place = start[node] + np.where(bit == 1, (length - n_ones)[node] + ones_before, np.arange(len(own), dtype=np.int32) - start[node] - ones_before)
            follows = np.empty_like(place)
            follows[place] = np.arange(len(own), dtype=np.int32)
            own, key = own[follows], (2 * node + bit)[follows]
            goes_on = size[own] > level + 1
            own, key = own[goes_on], key[goes_on]
            there = np.zeros(2 * nodes, bool)
            there[key] = True
            live, node = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[key]
            kids = np.full(2 * nodes, -1, np.int64)
            kids[live] = first + nodes + np.arange(len(live))
            child.append(kids.reshape(nodes, 2))
            first += nodes
            nodes = len(live)
        self.offset, self.child = (np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (offset, child))
        packed = np.packbits(np.concatenate([*bits, np.zeros(64 + -at % 64, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.base = self._ones(self.offset)

    def _ones(self, place: np.ndarray) -> np.ndarray:
        own = place >> 6
        mask = _BELOW[place & 63]
        return self.upto[own] + np.bitwise_count(self.words[own] & mask)

    def ranks(self, word: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each word stands before its place, for one or more places of each; words go down the tree together."""
        size = self.size[word]
        order = np.argsort(-size, kind="stable")
        size, code = size[order], self.code[word[order]]
        now = [x[order].astype(np.int32) for x in places]
        live = np.searchsorted(-size, -np.arange(self.depth + 1), "left").tolist()  # with a code longer than so many bits
        for x in now:
            x[live[0] :] = 0
        node = np.zeros(live[0], np.int32)
        for level in range(self.depth):
            k = live[level]
            if not k:
                break
            start, before = self.offset[node], self.base[node]
            bit = (code[:k] >> (self.depth - 1 - level)) & 1
            one = bit == 1
            for x in now:
                ones = self._ones(start + x[:k]) - before
                x[:k] = np.where(one, ones, x[:k] - ones)
            node = self.child[node[: live[level + 1]], bit[: live[level + 1]]]
        out = [np.empty(len(word), np.int64) for _ in now]
        for x, to in zip(now, out, strict=True):
            to[order] = x
        return out

    def rank(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.ranks(word, place)[0]


class FmIndex:
    """Index of sequences of words, given in a row with a 0 behind each; weights: occurrences that each stands for."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, n_words: int):
        if len(words) >= MOST:
            raise ValueError("an index holds fewer than 2^21 words")
        order, ranks = sort_suffixes(words)
        shared = np.append(common_prefixes(order, ranks), 0)
        del ranks
        self.shared, self.n = shared, len(words)
        # The parent of an interval lies between the nearest smaller shared prefixes on both sides.
        self.low = smaller_before(shared[:-1])
        self.high = self.n - smaller_before(shared[1:][::-1])[::-1]
        owner = np.cumsum(words == 0) - (words == 0)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner][order])])
        often = np.bincount(words, minlength=n_words)
        self.first = np.cumsum(often) - often
        self.tree = WaveletTree(words[order - 1], n_words)

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that start with a word before what each interval [low, high) has in common."""
        low, high = self.tree.ranks(word, low, high)
        first = self.first[word]
        return low + first, high + first

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider intervals, and how many words all of their suffixes share."""
        left, right = self.shared[low] * (low > 0), self.shared[high]
        depth = np.maximum(left, right)
        wider_low = np.where(left == depth, np.maximum(self.low[low], 0), low)
        wider_high = np.where((right == depth) & (high < self.n), self.high[np.minimum(high, self.n) - 1], high)
        root = depth == 0
        return np.where(root, 0, wider_low), np.where(root, self.n, wider_high), depth

    def matching_statistics(self, words: np.ndarray, stops: np.ndarray, least: int = 2, asked: int = 0, indexed: bool = False) -> np.ndarray:
        """For each place of sequences (stops: where each ends) the longest run from there on that occurs `least` times.

        asked: a sequence is left as soon as no run of so many words can follow in it; its other places stay 0.
        indexed: all sequences are sequences of the index. An interval of one suffix is then the sequence's own, which
        stands for `least` places by itself, so every longer run of it does too and needs no more search.

        Sequences are read backward: the interval of the longest run so far is extended by the
        word before it, and gives up words at its far end as long as fewer than `least` occurrences are left.
        """
        starts = np.concatenate([[0], stops[:-1]])
        out = np.zeros(len(words), np.int64)
        low, high, run = np.zeros(len(stops), np.int64), np.full(len(stops), self.n), np.zeros(len(stops), np.int64)
        at, own = stops - 1, np.arange(len(stops))
        while len(own := own[(at[own] >= starts[own]) & (run[own] + at[own] - starts[own] + 1 >= asked)]):
            new_low, new_high = self.extend(words[at[own]], low[own], high[own])
            enough = (self.weight[new_high] - self.weight[new_low] >= least) & (new_high > new_low)
            good = own[enough]
            low[good], high[good] = new_low[enough], new_high[enough]
            run[good] += 1
            out[at[good]] = run[good]
            bad = own[~enough]
            none = bad[run[bad] == 0]
            low[none], high[none] = 0, self.n
            at[good] -= 1
            at[none] -= 1
            bad = bad[run[bad] > 0]
            low[bad], high[bad], run[bad] = self.parent(low[bad], high[bad])
            if indexed:
                settled = good[high[good] - low[good] == 1]
                rest = at[settled] - starts[settled] + 1
                back = np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
                out[np.repeat(starts[settled], rest) + back] = np.repeat(run[settled] + rest, rest) - back
                at[settled] = -1
        return out
