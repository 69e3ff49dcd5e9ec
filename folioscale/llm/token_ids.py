"""Token ids of whole texts.

A text is cut at ASCII white space, which the vocabulary drops and across which it never merges, so a text's ids are
the ids of its parts in a row. A batch's parts are numbered and each distinct one is taken once: Latin letters with
signs behind them are two keys, the lower-case letters and the signs; any other part is a key of its own. Keys recur;
each worker keeps the ids of those it met as flat arrays, up to KEPT_BYTES, and gathers ids by number.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of keys and ids that a worker keeps, by estimate, before it starts anew.
KEPT_BYTES = 64 << 20
#: Parts whose ids are gathered at once, and letters that are encoded as one text.
BLOCK, RUN = 1 << 19, 256
#: Letters, and signs that follow them, which the vocabulary splits from each other and reads alike wherever they stand.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!\"#$%&()*+,\-./:;=?@^_`~]*)$"
_ENCODERS: dict[str, Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gather(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool that the numbers name, in a row, and where each ends."""
    upto = np.cumsum(sizes[number], dtype=np.int64)
    out = np.empty(int(upto[-1]) if len(upto) else 0, "<u4")
    for low in range(0, len(number), BLOCK):
        own = number[low : low + BLOCK]
        size, stop = sizes[own], upto[low : low + BLOCK]
        begin, last = int(stop[0] - size[0]), int(stop[-1])
        out[begin:last] = pool[np.repeat(first[own] - (stop - size), size) + np.arange(begin, last)]
    return out, upto


class _Keys:
    """Keys met so far and their ids: key i has pool[first[i] : first[i] + sizes[i]]. Key 0 is empty."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at, self.held = {"": 0}, 0
        self.pool, self.sizes = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.first = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in own for i in ids], "<u4"), np.fromiter(map(len, own), np.int64, len(own))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of letters: each has one end-of-word token, its last, so many are encoded as one text."""
        ids, _ = self._encode([" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self._encode(words)
        return ids, np.diff(stops, prepend=0)

    def numbers(self, keys: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Number of each key, new ones learnt; letters: which are of lower-case letters only."""
        coded = keys.dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.held > KEPT_BYTES:
            self.clear()
        found = [*map(self.at.get, distinct)]
        at = np.array([-1 if x is None else x for x in found], np.int64) if None in found else np.array(found, np.int64)
        new = at < 0
        if new.any():
            plain = np.zeros(len(distinct), bool)
            plain[index[letters]] = True
            for which, encode in ((new & plain, self._encode_words), (new & ~plain, self._encode)):
                if which.any():
                    places = np.flatnonzero(which)
                    more = [distinct[i] for i in places.tolist()]
                    ids, sizes = encode(more)
                    at[places] = len(self.at) + np.arange(len(more))
                    self.at.update(zip(more, at[places].tolist(), strict=True))
                    self.held += sum(map(len, more)) + 150 * len(more) + ids.nbytes
                    self.pool, self.sizes = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes])
            self.first = np.cumsum(self.sizes) - self.sizes
        return at[index]


def part_encoder(path: str) -> Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]:
    """The encoder for a lower-casing word vocabulary; one per worker process.

    It takes a column of UTF-8 texts (null: empty) and the end id, and gives the ids of all texts in a row, the end id
    behind each, and how many each text has.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    known = _Keys(Tokenizer.from_file(path))

    def encode(column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        stops = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        numbered = split.flatten().dictionary_encode()
        distinct = numbered.dictionary
        found = pc.extract_regex(distinct, _PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(pc.struct_field(found, "letters"))
        keys = pa.concat_arrays([pc.if_else(pa.array(plain), low, distinct), pc.if_else(pa.array(plain), pc.struct_field(found, "signs"), "")])
        units = known.numbers(keys, np.flatnonzero(plain)).reshape(2, -1).T.ravel()
        pool, upto = _gather(known.pool, known.first, known.sizes, units)
        # Distinct parts, and the end as one more.
        last = upto[1::2]
        pool = np.concatenate([pool, np.array([end_id], "<u4")])
        sizes = np.append(np.diff(last, prepend=0), 1)
        # The parts of all texts in a row, an end behind each text.
        number = np.full(len(numbered) + len(stops), len(distinct), np.int64)
        ends_at = stops + np.arange(len(stops))
        inner = np.ones(len(number), bool)
        inner[ends_at] = False
        number[inner] = numbered.indices.to_numpy()
        ids, upto = _gather(pool, np.cumsum(sizes) - sizes, sizes, number)
        return ids, np.diff(upto[ends_at], prepend=0)

    _ENCODERS[path] = encode
    return encode
