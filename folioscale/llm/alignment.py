"""Operator 13: the token streams of two tokenizers aligned by bytes, each distinct text once.

Documents are shuffled by their full text, so that copies are tokenised and aligned once and count by their number.
A text is cut into segments before each single space between two characters that are not white space: neither
vocabulary merges across such a place, and both streams end a token there, so the alignment of a text is that of its
segments in a row. A worker keeps the segments it met, up to KEPT_BYTES.

Texts are taken in chunks of CHUNK_BYTES. A chunk lists its distinct segments and their id pairs once; pairs and their
weights are summed over the corpus by Spark, joined back to the chunks that hold them, and folded over each text's
segments there. What is joined is a row for each chunk and pair, not for each link.
"""

from __future__ import annotations

import hashlib
import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm import common

#: Bytes of texts that make a chunk, at least, and of segments that a worker keeps, by estimate.
CHUNK_BYTES, KEPT_BYTES = 8 << 20, 64 << 20
#: Segments that are encoded as one text.
RUN = 256
CHUNK = "chunk string, n_texts long, blob binary, pairs binary, weights binary"
MEASURES = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ZEROS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_STREAMS: dict[tuple[str, str], Segments] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The letters of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


class Streams:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            self.bytes_a[number] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(len(self.b)))]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for segments, which start with a space; the second tokenizer sets that space itself."""
        return [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)], self.b.encode([x[1:] for x in segments], num_threads=1)


class Segments:
    """Segments met so far, their alignments and links; links of segment i are pool[first[i] : first[i] + n_links[i]]."""

    def __init__(self, path_a: str, path_b: str):
        self.streams = Streams(path_a, path_b)
        n = len(self.streams.bytes_a), len(self.streams.bytes_b)
        self.written = [[f"{i}{mark}" for mark in ",|" for i in range(n[0])], [f"{i}{mark}" for mark in ",;" for i in range(n[1])]]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.held = 0
        self.numbers = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, 1 if its bytes come back
        self.pool, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []

    def find(self, segments: list[str], plain: np.ndarray) -> np.ndarray:
        """Numbers of segments, new ones learnt; plain: those without white space behind their first space."""
        if self.held > KEPT_BYTES:
            self.clear()
        at = np.array([self.at.get(x, -1) for x in segments], np.int64)
        for which, size in ((plain, RUN), (~plain, 1)):
            new = np.flatnonzero(which & (at < 0)).tolist()
            runs = [[segments[i] for i in new[low : low + size]] for low in range(0, len(new), size)]
            self._learn(runs)
        return np.array([self.at[x] for x in segments], np.int64) if (at < 0).any() else at

    def _learn(self, runs: list[list[str]]) -> None:
        streams, kept = self.streams, []
        for low in range(0, len(runs), 256):
            part = runs[low : low + 256]
            joined = ["".join(run) for run in part]
            for run, text, a, b in zip(part, joined, *streams.encode(joined), strict=True):
                sides = b"".join(streams.bytes_a[i] for i in a), b"".join(streams.bytes_b[i] for i in b)
                whole = text.encode()
                if sides[0] == whole == sides[1]:
                    kept.append((run, np.array(a, np.int64), np.array(b, np.int64)))
                elif len(run) > 1:  # one of them does not come back: each on its own
                    self._learn([[x] for x in run])
                else:
                    self._add(run, [""], np.zeros((1, 5), np.int64), np.zeros(0, np.int64))
            if kept:  # what comes back is aligned together: tokens of both sides end where a run ends
                runs_kept, a, b = zip(*kept, strict=True)
                together = [x for run in runs_kept for x in run]
                self._add(together, *self._align(together, np.concatenate(a), np.concatenate(b)))
                kept = []

    def _align(self, run: list[str], a: np.ndarray, b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        ends = np.cumsum([len(x.encode()) for x in run])
        end_a, end_b = np.cumsum(self.streams.size_a[a]), np.cumsum(self.streams.size_b[b])
        cuts, every = np.intersect1d(end_a, end_b), np.union1d(end_a, end_b)
        # A link is a stretch between two ends of any kind: it lies in one token of each side.
        links = a[np.searchsorted(end_a, every)] * len(self.streams.bytes_b) + b[np.searchsorted(end_b, every)]
        upto = np.stack([np.searchsorted(x, ends, "right") for x in (end_a, end_b, cuts, every)], 1)
        numbers = np.concatenate([np.diff(upto, axis=0, prepend=0), np.ones((len(run), 1), np.int64)], 1)
        # The ids of a group, those of the first side before those of the second, each with the sign that follows it.
        group = np.concatenate([np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * group + side, kind="stable")
        last = np.append(np.diff((2 * group + side)[order]) != 0, True)
        ids, side = np.concatenate([a, b])[order], side[order]
        signs = [self.written[s][i] for s, i in zip(side.tolist(), (ids + last * np.where(side, len(self.written[1]) // 2, len(self.written[0]) // 2)).tolist(), strict=True)]
        stops = np.concatenate([[0], upto[:, 0] + upto[:, 1]])
        return ["".join(signs[i:j]) for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], numbers, links

    def _add(self, run: list[str], groups: list[str], numbers: np.ndarray, links: np.ndarray) -> None:
        for i, segment in enumerate(run):
            self.at[segment] = len(self.at)
            self.held += 2 * len(segment) + len(groups[i]) + 250
        self.groups += groups
        self.pending.append((numbers, links))
        self.held += numbers.nbytes + links.nbytes

    def settle(self) -> None:
        """Take what was learnt into the flat arrays."""
        if self.pending:
            self.numbers = np.concatenate([self.numbers, *[x[0] for x in self.pending]])
            self.pool = np.concatenate([self.pool, *[x[1] for x in self.pending]])
            self.first = np.cumsum(self.numbers[:, 3]) - self.numbers[:, 3]
            self.pending.clear()


def segments_of(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """For texts that are not empty: number of each segment in a row, the distinct ones, which of these are plain, and where each text stops."""
    split = pc.split_pattern(column, " ")
    stops = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    parts, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    opens = np.array([bool(x) and not x[0].isspace() for x in parts], bool)
    closes = np.array([bool(x) and not x[-1].isspace() for x in parts], bool)
    plain = np.array([len(x.split()) == 1 and opens[i] and closes[i] for i, x in enumerate(parts)], bool)
    starts = np.zeros(len(index), bool)
    starts[1:] = closes[index[:-1]] & opens[index[1:]]
    starts[0] = True
    starts[stops[:-1]] = True
    begin = np.flatnonzero(starts)
    size = np.diff(begin, append=len(index))
    number, names = index[begin], [f" {x}" for x in parts]
    known: dict[str, int] = {}
    for i in np.flatnonzero(size > 1).tolist():  # spaces that stand next to white space
        name = " " + " ".join(parts[k] for k in index[begin[i] : begin[i] + size[i]].tolist())
        number[i] = known.setdefault(name, len(names) + len(known))
    names += list(known)
    used, number = np.unique(number, return_inverse=True)
    plain = np.concatenate([plain, np.zeros(len(known), bool)])[used]
    return number, [names[i] for i in used.tolist()], plain, np.searchsorted(begin, stops)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as four rows of bytes, which a compressor shrinks well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def align_chunks(texts: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of distinct texts (key, text, n): what each text's measures need, and the chunk's id pairs with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        known = _STREAMS.get((path_a, path_b)) or _STREAMS.setdefault((path_a, path_b), Segments(path_a, path_b))
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            number, names, plain, stops = segments_of(rows["text"].combine_chunks())
            own = known.find(names, plain)
            known.settle()
            # The chunk's own segments by falling frequency: small numbers recur.
            often = np.bincount(number, minlength=len(names))
            order = np.argsort(-often, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            own, number = own[order], place[number]
            counts = known.numbers[own]
            links = np.concatenate([np.zeros(0, np.int64), *[known.pool[i : i + n] for i, n in zip(known.first[own].tolist(), counts[:, 3].tolist(), strict=True)]])
            begins = np.concatenate([[0], stops[:-1]])
            whole = np.minimum.reduceat(counts[number, 4], begins) > 0
            sums = np.add.reduceat(counts[number, :4], begins) * whole[:, None]
            groups = [known.groups[i] for i in own.tolist()]
            digests = [hashlib.sha256("".join([groups[k] for k in number[i:j].tolist()])[:-1].encode()).hexdigest() if ok else "" for i, j, ok in zip(begins.tolist(), stops.tolist(), whole.tolist(), strict=True)]
            # Weights: how often a segment stands in texts that come back, times the copies of each.
            copies = rows["n"].to_numpy() * whole
            weight = np.bincount(number, np.repeat(copies, np.diff(stops, prepend=0)), len(own)).astype(np.int64)
            pairs, local = np.unique(links, return_inverse=True)
            weights = np.bincount(local, np.repeat(weight, counts[:, 3]), len(pairs)).astype(np.int64)
            blob = {"keys": b"".join(rows["key"].to_pylist()), "sums": sums.astype("<i8").tobytes(), "digests": digests, "stops": stops.astype("<i8").tobytes(), "number": _planes(number), "n_links": _planes(counts[:, 3]), "local": _planes(local)}
            packed = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(blob))
            return pa.RecordBatch.from_pydict({"chunk": [f"{part}-{seq}"], "n_texts": [len(stops)], "blob": [packed], "pairs": [pairs.astype("<i8").tobytes()], "weights": [weights.astype("<i8").tobytes()]})

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chunk_bytes:
                yield chunk()
                held, size, seq = [], 0, seq + 1
                common.release()
        if sum(x.num_rows for x in held):
            yield chunk()

    return common.map_arrow(texts.select("key", "text", "n"), run, CHUNK)


def _pair_rows(chunks: DataFrame, size_b: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, weights = np.frombuffer(row["pairs"], "<i8"), np.frombuffer(row["weights"], "<i8")
                for low in range(0, len(pairs), 1 << 16):
                    own = slice(low, low + (1 << 16))
                    n = len(pairs[own])
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * n), pa.array(np.arange(low, low + n)), pa.array(pairs[own] // size_b), pa.array(pairs[own] % size_b), pa.array(weights[own])], names=["chunk", "place", "a_id", "b_id", "weight"])

    return common.map_arrow(chunks.select("chunk", "pairs", "weights"), run, "chunk string, place long, a_id long, b_id long, weight long", rows=1)


def _fold(chunks: DataFrame, scores: DataFrame) -> DataFrame:
    """Measures of each text of the chunks; scores: for each chunk its pairs' places, counts and whether they are the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for row in range(batch.num_rows):
                blob = pickle.loads(zstandard.ZstdDecompressor().decompress(batch.column("blob")[row].as_py()))
                sums, stops = np.frombuffer(blob["sums"], "<i8").reshape(-1, 4), np.frombuffer(blob["stops"], "<i8")
                number, n_links, local = (_numbers(blob[x]) for x in ("number", "n_links", "local"))
                found = batch.column("scores")[row].values
                count, best = (np.zeros(int(local.max()) + 1 if len(local) else 0, np.int64) for _ in range(2))
                if found is not None:
                    place = found.field("place").to_numpy()
                    count[place], best[place] = found.field("count").to_numpy(), found.field("best").to_numpy()
                # Sums over a segment's links, then over a text's segments.
                upto = np.concatenate([[0], np.cumsum(n_links)])
                own = [np.diff(np.concatenate([[0], np.cumsum(x[local])])[upto]) for x in (best, count)]
                begins = np.concatenate([[0], stops[:-1]])
                whole = np.array([bool(x) for x in blob["digests"]], bool)
                more = [np.add.reduceat(x[number], begins) * whole for x in own]
                keys = common.binary_array(np.frombuffer(blob["keys"], np.uint8), 32 * np.arange(1, len(stops) + 1))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x) for x in (*sums.T.copy(), *more)], pa.array(blob["digests"])], names=[x.split()[0] for x in MEASURES.split(", ")])

    return common.map_arrow(chunks.select("chunk", "blob").join(scores, "chunk", "left").select("blob", "scores"), run, MEASURES, rows=1)


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Measures of each row of docs by doc_id, and the id pairs of the corpus.

    Measures: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pairs: a_id, b_id, count (links that
    hold the two, over all rows), best (no other pair of that b_id has a higher count). Only doc_id and text are read. A
    null or empty text, and one whose bytes do not come back from both streams, has no tokens: zeros and an empty digest.
    Repeated rows count each, and each has its row. A null doc_id stays null. An empty table gives two empty ones.
    """
    defaults = default_paths()
    path_a, path_b = path_a or defaults[0], path_b or defaults[1]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    # The shuffle's partitions stay as they are: a merged one would only make a task longer.
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "n")
    chunks = common.cut(align_chunks(texts, path_a, path_b, chunk_bytes), "aligned")
    from sentencepiece import SentencePieceProcessor

    held = _pair_rows(chunks, len(SentencePieceProcessor(model_file=path_b)))
    summed = held.filter("weight > 0").groupBy("a_id", "b_id").agg(F.sum("weight").alias("count"))
    summed = common.cut(summed, "pairs")
    highest = F.broadcast(summed.groupBy("b_id").agg(F.max("count").alias("highest")))  # a row for each id of one vocabulary at most
    pairs = summed.join(highest, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("highest")).alias("best"))
    found = held.select("chunk", "place", "a_id", "b_id").join(pairs, ["a_id", "b_id"])
    # A chunk's own pairs, which its links bound.
    scores = found.groupBy("chunk").agg(F.collect_list(F.struct("place", "count", F.col("best").cast("long").alias("best"))).alias("scores"))
    keyed = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    measured = keyed.join(_fold(chunks, scores), "key", "left")
    return measured.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ZEROS], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), pairs


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of byte-level and piece tokens of every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
