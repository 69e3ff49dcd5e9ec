"""Operator 7: language-model scores from an n-gram trie in Elias-Fano levels.

Counting is one shuffle over all training texts. A word is known by its 64-bit hash, a successor by its first 40 bits.
A task sums the n-grams of some millions of tokens and sends a row for each context, with its successors and their
counts packed side by side. Contexts are dealt by hash and sorted; the task that gets a context merges its successors
and writes them: levels are shards of about SHARD entries, with contexts, monotone pointers to their successors, and
successors relative to their context, all as Elias-Fano sequences, and with probabilities and back-off weights
quantised to a byte. A single token's count is the sum of its successors' counts, as every token but the end is
followed by one, and the end stands in front of every text.

Scoring tasks gather the n-grams of some millions of tokens, map one shard after the other and search the successors
within their context, so a task's memory holds neither the model nor more than its tokens.

Probabilities are interpolated with absolute discounting: p(w | context) = (n - D) / total + backoff * p(w | shorter
context); the shortest is the add-half estimate of single tokens. N-grams seen fewer than MIN_COUNT times leave their
mass to the back-off.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm import common, elias_fano

ORDER = 2
MIN_COUNT = 1
DISCOUNT = 0.75
SHARD = 1 << 20
#: Tokens that a task holds at once.
CHUNK = 1 << 20
#: Bits of a successor that are kept beside its context.
SUCCESSOR_BITS = 40
_FLIP = np.uint64(1 << 63)
_FLOOR = -8.0
END = xxhash.xxh64_intdigest(b"\n")
_CUT = np.uint64(64 - SUCCESSOR_BITS)
#: What a task packs into one row at most: more successors of a context in several rows.
_ROW_SUCCESSORS = 1 << 16


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context that is longer by a word."""
    x = (context ^ (word + np.uint64(0x9E3779B97F4A7C15) + (context << np.uint64(6)) + (context >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _hashes(words: list[bytes]) -> np.ndarray:
    numbered = pa.array(words, pa.binary()).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x) for x in numbered.dictionary.to_pylist()], np.uint64)[numbered.indices.to_numpy()]


#: Bytes from which a text is cut into blocks.
LONG = 1 << 24


def token_blocks(column: pa.Array, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the tokens of a column of texts (null: empty), the end of each included: hashes of the tokens, the keep
    tokens before the block (ends in front of a text), each token's place in its text, and the number of its text."""
    column = pc.fill_null(column, "")
    long = np.flatnonzero(pc.binary_length(column).to_numpy() > LONG)
    front = np.full(keep, END, np.uint64)
    low = 0
    for at in [*long.tolist(), len(column)]:
        if at > low:
            split = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(low, at - low)))
            stops = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
            numbered = split.flatten().dictionary_encode()
            distinct, digest = numbered.dictionary.cast(pa.binary()).to_pylist(), xxhash.xxh64_intdigest
            words = numbered.indices.to_numpy()
            real = np.array([x != b"" for x in distinct], bool)[words]
            sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[stops], prepend=0) + 1
            ends = np.cumsum(sizes)
            tokens = np.full(int(ends[-1]), END, np.uint64)
            inner = np.ones(len(tokens), bool)
            inner[ends - 1] = False
            tokens[inner] = np.array([digest(x) for x in distinct], np.uint64)[words[real]]
            owner = np.repeat(np.arange(low, at), sizes)
            yield tokens, front, np.arange(len(tokens)) - np.repeat(ends - sizes, sizes), owner
        if at < len(column):
            before, place = front, 0
            for words in common.word_blocks(column[at].as_py().encode().lower()):
                tokens = _hashes(words)
                yield tokens, before, np.arange(place, place + len(tokens)), np.full(len(tokens), at)
                before, place = np.concatenate([before, tokens])[len(tokens) :], place + len(tokens)
            yield np.array([END], np.uint64), before, np.array([place]), np.array([at])
        low = at + 1


def contexts(tokens: np.ndarray, before: np.ndarray, place: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from 2 to order, of each token: the hash of its context, and whether there is one.

    before: the last order - 1 tokens. The end that stands in front of a text is a context; longer ones are made of it
    and the text's own tokens only, so they begin with the end of the text before, if at all.
    """
    joined, size, out = np.concatenate([before, tokens]), len(tokens), []
    for level in range(2, order + 1):
        whole = joined[order - level : order - level + size]
        for k in range(order - level + 1, order - 1):
            whole = _mix(whole, joined[k : k + size])
        out.append((whole, place >= level - 2))
    return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _signed(values: np.ndarray) -> pa.Array:
    """Unsigned numbers as longs of the same order."""
    return pa.array((values ^ _FLIP).view(np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64) ^ _FLIP


def _grouped(ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same n-grams summed and sorted by context and successor."""
    order = np.lexsort((word, ctx))
    ctx, word, n = ctx[order], word[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])]))
    return ctx[first], word[first], np.add.reduceat(n, first)


def _numbered_pairs(ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of ctx and word in order, and the numbers of both. ctx is mostly the word before."""
    follows = np.zeros(len(word), bool)
    follows[1:] = ctx[1:] == word[:-1]
    other = np.flatnonzero(~follows)
    values, at = np.unique(np.concatenate([word, ctx[other]]), return_inverse=True)
    left = np.empty(len(word), np.int64)
    left[1:] = at[: len(word) - 1]
    left[other] = at[len(word) :]
    return values, left, at[: len(word)]


def _counted_pairs(ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word pairs summed and sorted by context and successor."""
    values, left, right = _numbered_pairs(ctx, word)
    code, n = np.unique(left * len(values) + right, return_counts=True)
    return values[code // len(values)], values[code % len(values)], n


def _pack_successors(word: np.ndarray) -> np.ndarray:
    """40-bit successors as rows of five bytes."""
    return word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _unpack_successors(data: bytes) -> np.ndarray:
    rows = np.zeros((len(data) // 5, 8), np.uint8)
    rows[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return rows.view("<u8").ravel()


_PACKED = "part int, level int, ctx long, successors binary, counts binary"


def packed_ngrams(docs: DataFrame, order: int, parts: int, text: str = "text") -> DataFrame:
    """A row for each context that a task met, with its successors and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order - 1)]
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for level in range(2, order + 1):
                ctx, tokens = (np.concatenate(x) for x in zip(*held[level - 2], strict=True))
                held[level - 2].clear()
                if not len(ctx):
                    continue
                if level == 2:  # words in order, so their first bits are too
                    ctx, word, n = _counted_pairs(ctx, tokens)
                    word = word >> _CUT
                else:
                    ctx, word, n = _grouped(ctx, tokens >> _CUT, np.ones(len(ctx), np.int64))
                del tokens
                new = np.concatenate([[True], ctx[1:] != ctx[:-1]])
                new[::_ROW_SUCCESSORS] = True
                starts = np.flatnonzero(new)
                ends = np.concatenate([starts[1:], [len(ctx)]])
                successors, counts = _pack_successors(word).tobytes(), n.astype("<u4").tobytes()
                for low in range(0, len(starts), 1 << 15):
                    a, b = starts[low : low + (1 << 15)], ends[low : low + (1 << 15)]
                    off = np.concatenate([a - a[0], [b[-1] - a[0]]]).astype(np.int32)
                    base, stop = int(a[0]), int(b[-1])
                    packed = [pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((off * k).astype(np.int32).tobytes()), pa.py_buffer(data[k * base : k * stop])]) for k, data in ((5, successors), (4, counts))]
                    own = ctx[a]
                    yield pa.RecordBatch.from_arrays([pa.array((own % np.uint64(parts)).astype(np.int32)), pa.array(np.full(len(a), level, np.int32)), _signed(own), *packed], names=["part", "level", "ctx", "successors", "counts"])
            size = 0

        for batch in batches:
            for tokens, before, place, _ in token_blocks(batch.column(0), order - 1):
                for level, (whole, there) in enumerate(contexts(tokens, before, place, order), 2):
                    held[level - 2].append((whole[there], tokens[there]))
                size += len(tokens)
                if size >= CHUNK:
                    yield from given()
        if size:
            yield from given()

    return common.map_arrow(docs.select(F.col(text).cast("string").alias("text")), count, _PACKED)


def _code(share: np.ndarray) -> np.ndarray:
    """Decimal logarithm in 255 steps from 1 down to 1e-8."""
    return np.rint(np.clip(np.log10(np.maximum(share, 1e-30)), _FLOOR, 0) / _FLOOR * 255).astype(np.uint8)


_SHARES = 10.0 ** (np.arange(256) / 255 * _FLOOR)


def encode_counts(word: np.ndarray, n: np.ndarray) -> bytes:
    """Level 1: sorted tokens and their counts."""
    return _bind(len(word), [elias_fano.encode(word, 1 << 64), n.astype("<u8").tobytes()])


def encode_shard(heads: np.ndarray, sizes: np.ndarray, backoff: np.ndarray, successor: np.ndarray, share: np.ndarray) -> bytes:
    """A higher level: sorted contexts with their number of successors and back-off weight, then all successors in a row."""
    rank = np.repeat(np.arange(len(heads), dtype=np.uint64), sizes)
    pointers = np.concatenate([[0], np.cumsum(sizes)])
    parts = [elias_fano.encode(heads, 1 << 64), elias_fano.encode(pointers, len(rank) + 1), elias_fano.encode(rank << np.uint64(SUCCESSOR_BITS) | successor, len(heads) << SUCCESSOR_BITS), _code(share).tobytes(), _code(backoff).tobytes()]
    return _bind(len(rank), parts)


def _bind(n: int, parts: list[bytes]) -> bytes:
    parts = [p + bytes(-len(p) % 8) for p in parts]
    return struct.pack("<QQ", n, len(parts)) + np.cumsum([0, *map(len, parts)]).astype("<u8").tobytes() + b"".join(parts)


class Shard:
    """One shard of a level in a (mapped) buffer."""

    def __init__(self, level: int, buffer):
        self.level = level
        self.n, parts = struct.unpack_from("<QQ", buffer, 0)
        base = 16 + 8 * (parts + 1)
        at = [base + int(x) for x in np.frombuffer(buffer, "<u8", parts + 1, 16)]
        if level == 1:
            self.words = elias_fano.Sequence(buffer, at[0])
            self.counts = np.frombuffer(buffer, "<u8", self.n, at[1])
        else:
            self.contexts, self.pointers, self.successors = (elias_fano.Sequence(buffer, a) for a in at[:3])
            self.share = np.frombuffer(buffer, np.uint8, self.n, at[3])
            self.backoff = np.frombuffer(buffer, np.uint8, self.contexts.n, at[4])

    def count(self, word: np.ndarray) -> np.ndarray:
        """Counts of tokens, 0 for unknown ones (level 1)."""
        entry, found = self.words.successor(word)
        out = np.zeros(len(word))
        out[found] = self.counts[entry[found]]
        return out

    def find(self, ctx: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each n-gram (0 if unknown) and back-off weight of its context (1 if unknown); sizes: n-grams of each context in word."""
        rank, known = self.contexts.successor(ctx)
        rank = np.where(known, rank, 0)
        backoff = np.repeat(np.where(known, _SHARES[self.backoff[rank]], 1.0), sizes)
        first, last = (self.pointers.get(r).astype(np.int64) for r in (rank, rank + 1))
        owner = np.repeat(np.arange(len(ctx)), sizes)
        at = np.flatnonzero(known[owner])
        owner = owner[at]
        entry, found = self.successors.successor(rank[owner].astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | word[at] >> _CUT)
        inside = found & (first[owner] <= entry) & (entry < last[owner])
        share = np.zeros(len(word))
        share[at[inside]] = _SHARES[self.share[entry[inside]]]
        return share, backoff


@dataclass
class Model:
    order: int
    tokens: int  # N
    distinct: int  # V
    path: str
    parts: int
    shards: dict[tuple[int, int], list[tuple[int, str]]]  # by level and part: first context (level 1: token) and file, in order


def _merge(path: str, order: int, min_count: int):
    """Reads packed rows sorted by part, level and context; writes their levels' shards and gives a row for each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None  # part and level of what is held
        tokens: list[tuple[np.ndarray, np.ndarray]] = []  # level 1, from the sums of level 2
        higher: list[tuple[np.ndarray, ...]] = []
        entries = 0
        left = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))  # the last context, which may go on

        def row(level: int, first: int, payload: bytes, n: int, total: int) -> pa.RecordBatch:
            file = f"{level}-{uuid.uuid4().hex}.trie"
            common.write_file(f"{path}/{file}", payload)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([level], pa.int32()), pa.array([first - (1 << 63)], pa.int64()), pa.array([file]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["part", "level", "ctx", "file", "n", "total"])

        def settle(ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
            """Take whole contexts in."""
            nonlocal entries
            if not len(ctx):
                return
            ctx, word, n = _grouped(ctx, word, n)
            heads = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            totals = np.add.reduceat(n, heads)
            if key[1] == 2:
                tokens.append((ctx[heads], totals))
            if key[1] > order:
                return
            kept = n >= min_count
            number = np.add.reduceat(kept.astype(np.int64), heads)
            mass = np.add.reduceat(np.where(kept, n - DISCOUNT, 0.0), heads)
            share = (n - DISCOUNT) / np.repeat(totals, np.diff(np.concatenate([heads, [len(n)]])))
            some = number > 0
            higher.append((ctx[heads][some], number[some], (1 - mass / totals)[some], word[kept], share[kept]))
            entries += int(kept.sum())

        def written(all_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal entries
            if tokens and (all_ or sum(len(x[0]) for x in tokens) >= SHARD):
                word, n = (np.concatenate(x) for x in zip(*tokens, strict=True))
                tokens.clear()
                yield row(1, int(word[0]), encode_counts(word, n), len(word), int(n.sum()))
            if higher and (all_ or entries >= SHARD):
                columns = [np.concatenate(x) for x in zip(*higher, strict=True)]
                higher.clear()
                entries = 0
                if len(columns[0]):
                    yield row(key[1], int(columns[0][0]), encode_shard(*columns), len(columns[3]), 0)

        for batch in batches:
            part, level = batch.column("part").to_numpy(), batch.column("level").to_numpy()
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (level[1:] != level[:-1])) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key != (part[a], level[a]):
                    if key is not None:
                        settle(*left)
                        left = tuple(x[:0] for x in left)
                        yield from written(True)
                    key = (int(part[a]), int(level[a]))
                own = batch.slice(a, b - a)
                data = own.column("successors").to_pylist()
                sizes = np.fromiter((len(x) // 5 for x in data), np.int64, len(data))
                ctx = np.concatenate([left[0], np.repeat(_unsigned(own.column("ctx")), sizes)])
                word = np.concatenate([left[1], _unpack_successors(b"".join(data))])
                n = np.concatenate([left[2], np.frombuffer(b"".join(own.column("counts").to_pylist()), "<u4").astype(np.int64)])
                last = np.searchsorted(ctx, ctx[-1])
                settle(ctx[:last], word[:last], n[:last])
                left = _grouped(ctx[last:], word[last:], n[last:])
                yield from written(False)
        if key is not None:
            settle(*left)
            yield from written(True)

    return merge


def build(docs: DataFrame, path: str | None = None, order: int = ORDER, min_count: int = MIN_COUNT, text: str = "text") -> Model:
    """Count the n-grams of all docs and write the trie's shards below path (a folder that all executors share)."""
    spark = docs.sparkSession
    path = path or common.fresh_path(spark, "trie")
    parts = common.partitions(spark)
    packed = packed_ngrams(docs, max(order, 2), parts, text).repartition(parts, "part").sortWithinPartitions("part", "level", "ctx")
    manifest = common.cut(common.map_arrow(packed, _merge(path, order, min_count), "part int, level int, ctx long, file string, n long, total long"), "shards")
    shards: dict[tuple[int, int], list[tuple[int, str]]] = {}
    tokens = distinct = 0
    for r in manifest.orderBy("level", "part", "ctx").collect():  # a row for each file of about a million entries
        shards.setdefault((r.level, r.part), []).append((r.ctx + (1 << 63), r.file))
        if r.level == 1:
            tokens, distinct = tokens + r.total, distinct + r.n
    return Model(order, tokens, distinct, path, parts, shards)


def _by_shard(model: Model, level: int, ctx: np.ndarray) -> Iterator[tuple[np.ndarray, str]]:
    """Places of the contexts that belong to each shard, and its file."""
    part = (ctx % np.uint64(model.parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    starts = np.searchsorted(part[order], np.arange(model.parts + 1))
    for number in range(model.parts):
        own = order[starts[number] : starts[number + 1]]
        files = model.shards.get((level, number))
        if not len(own) or not files:
            continue
        at = np.searchsorted(np.array([f[0] for f in files], np.uint64), ctx[own], side="right") - 1
        for k in np.unique(at[at >= 0]):
            yield own[at == k], files[k][1]


def token_scores(model: Model, tokens: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of the base probability, log10 of the model's, and whether it is known, of each token in its contexts."""
    whole = above[0][0] if above else tokens
    words, left, at = _numbered_pairs(whole, tokens)
    count = np.zeros(len(words))
    for own, file in _by_shard(model, 1, words):
        with common.mapped_file(f"{model.path}/{file}") as buffer:
            count[own] = Shard(1, buffer).count(words[own])
    base = ((count + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))[at]
    share = base
    for level, (whole, there) in enumerate(above, 2):
        if level > 2:
            chains, left = np.unique(whole, return_inverse=True)
        else:
            chains = words
        code, back = np.unique(left * len(words) + at, return_inverse=True)  # by context, then by word
        ctx, sizes = np.unique(code // len(words), return_counts=True)
        starts, word = np.cumsum(sizes) - sizes, words[code % len(words)]
        value, weight = np.zeros(len(code)), np.ones(len(code))
        for own, file in _by_shard(model, level, chains[ctx]):
            n = sizes[own]
            pairs = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            with common.mapped_file(f"{model.path}/{file}") as buffer:
                value[pairs], weight[pairs] = Shard(level, buffer).find(chains[ctx[own]], n, word[pairs])
        share = np.where(there, value[back] + weight[back] * share, share)
    return np.log10(base), np.log10(share), count[at] > 0


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of docs; a null text is empty."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = model.order
        ids: list[int | None] = []  # of the texts whose tokens are held
        blocks: list[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = []
        size = 0
        sums = np.zeros((0, 4))

        def settle() -> None:
            nonlocal size, sums
            if not blocks:
                return
            owner, tokens = (np.concatenate([b[i] for b in blocks]) for i in range(2))
            above = [tuple(np.concatenate([b[2][k][i] for b in blocks]) for i in range(2)) for k in range(order - 1)]
            base, full, known = token_scores(model, tokens, above)
            more = np.stack([np.bincount(owner, w, len(ids)) for w in (np.ones(len(tokens)), known.astype(float), base, full)], 1)
            more[: len(sums)] += sums
            sums, size = more, 0
            blocks.clear()

        def given() -> pa.RecordBatch:
            nonlocal sums
            settle()
            columns = [pa.array(ids, pa.int64()), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(sums[:, 2].copy()), pa.array(sums[:, 3].copy())]
            ids.clear()
            sums = np.zeros((0, 4))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            first = len(ids)
            ids += batch.column("doc_id").to_pylist()
            for tokens, before, place, owner in token_blocks(batch.column("text"), order - 1):
                blocks.append((first + owner, tokens, contexts(tokens, before, place, order)))
                size += len(tokens)
                if size >= CHUNK:
                    settle()  # a text can go on in the next chunk
            if len(ids) >= 10_000:
                yield given()
        if ids:
            yield given()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.map_arrow(rows, score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def language_model_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows that are not held out are the training texts; a null doc_id is not held out. A null or empty text is its end
    only. Repeated rows are counted and scored each. Without training texts every token has the same share. An empty
    table has no rows.
    """
    model = build(docs.where(~held_out()), None, order, min_count, text)
    scored = score_texts(docs, model, text)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_trie_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model of the training documents."""
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
