"""Operator 11: words of passages that stand elsewhere too are removed, found with FM-indexes of shards.

Which words can stand in equal windows is decided by anchors: of the runs of ANCHOR words inside a window, the one with
the smallest hash. Equal windows have equal anchors at equal places, and neighbouring windows mostly share one, so the
windows of a text fall into stretches of one anchor each. Only stretches whose anchor occurs at least twice in the corpus
go on. They are dealt to shards by their anchor; equal stretches are one, with their number. A shard's stretches make
an FM-index, and the same stretches are streamed against it: a window is repeated if the matching statistic at its
start, for runs that occur twice or more, reaches the window's length. So each stretch meets one index, whatever the
size of the corpus.

An anchor with more than HOT_STRETCHES different stretches would be a shard of any size: its stretches are dealt again
window by window, each with a hash of the whole window for its anchor.

Texts are kept in chunk files of the shared folder, written once and read by path, so that they are never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm import common
from folioscale.llm.fm_index import FmIndex
from folioscale.llm.interning import lanes_of, xxh64

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 35, 8
#: Bytes of texts in a chunk file, at least; words of a shard's index, at least; stretches of one anchor, at most.
CHUNK_BYTES, SHARD_WORDS, HOT_STRETCHES = 8 << 20, 250_000, 8_000
#: Numbers of a stretch as they are kept beside a chunk's texts: its anchor, first word and windows.
STORED = ["<u8", "<u4", "<u2"]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]  # fixed values of a public 64-bit mixer


class Words:
    """Words of a column of texts (null: none): where each starts and stops in data, and the first of each text."""

    def __init__(self, column: pa.Array):
        texts = common.text_bytes(column)
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        inner = ~_SPACE[self.data]
        edges = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        self.starts, self.stops = edges[::2], edges[1::2]
        ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends)])
        # Gaps so far that are not one space.
        odd = (self.starts[1:] - self.stops[:-1] != 1) | (self.data[self.stops[:-1]] != 0x20)
        self.odd = np.concatenate([[0], np.cumsum(odd)])

    def hashes(self) -> np.ndarray:
        sizes = self.stops - self.starts
        out, step = np.empty(len(sizes), np.uint64), 1 << 18
        for low in range(0, len(sizes), step):
            part = slice(low, low + step)
            out[part] = xxh64(self.data, self.starts[part], sizes[part], lanes_of(self.data, self.starts[part], sizes[part]))
        return out

    def run(self, low: int, high: int) -> bytes:
        """Words low to high, one space apart."""
        own = self.data[self.starts[low] : self.stops[high - 1]].tobytes()
        return own if self.odd[low] == self.odd[high - 1] else b" ".join(own.split())


def stretches(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first word and number of windows of each stretch."""
    n = len(words.starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.astype(np.uint64), none, none
    own, grams = words.hashes(), np.zeros(n - anchor + 1, np.uint64)
    for i in range(anchor):
        grams = grams * _MIX[0] + own[i : i + len(grams)]
    for k in (1, 2):
        grams = (grams ^ (grams >> np.uint64(30))) * _MIX[k]
    # The smallest of the last `span` hashes and its leftmost place, by doubling the reach.
    span = window - anchor + 1
    least, place, reach = grams, np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        size = len(least) - step
        right = least[step:] < least[:size]
        least, place = np.where(right, least[step:], least[:size]), np.where(right, place[step:], place[:size])
        reach += step
    # Windows inside one text, in stretches of one anchor.
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    at = place[inside]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)]) if len(inside) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return least[inside][begin], inside[begin], np.diff(begin, append=len(inside))


def write_chunks(docs: DataFrame, path: str, window: int, anchor: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk files of doc_id and text below path; for each its name and its distinct anchors with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            name = f"{uuid.uuid4().hex}.arrow"
            common.write_file(f"{path}/{name}", sink.getvalue())
            found = stretches(Words(rows["text"].combine_chunks()), window, anchor)
            common.write_file(f"{path}/{name}.stretches", b"".join(x.astype(kind).tobytes() for x, kind in zip(found, STORED, strict=True)))
            anchors, n = np.unique(found[0], return_counts=True)
            return pa.RecordBatch.from_pydict({"chunk": [name], "anchors": [anchors.astype("<u8").tobytes()], "numbers": [n.astype("<i8").tobytes()]})

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chunk_bytes:
                yield chunk()
                held, size = [], 0
                common.release()
        if sum(x.num_rows for x in held):
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, run, "chunk string, anchors binary, numbers binary")


def read_chunk(uri: str) -> tuple[pa.Table, list[np.ndarray]]:
    """doc_id and text of a chunk, and its stretches."""
    files, path = common.store(uri)
    with files.open_input_file(path) as source:
        rows = pa.ipc.open_file(source).read_all()
    with files.open_input_stream(f"{path}.stretches") as source:
        data = source.read()
    n, out, at = len(data) // sum(np.dtype(x).itemsize for x in STORED), [], 0
    for kind in STORED:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return rows, out


def _anchor_rows(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors, n = np.frombuffer(row["anchors"], "<i8"), np.frombuffer(row["numbers"], "<i8")
                for low in range(0, len(anchors), 1 << 16):
                    own = slice(low, low + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(anchors[own])), pa.array(anchors[own]), pa.array(n[own])], names=["chunk", "anchor", "n"])

    return common.map_arrow(chunks, run, "chunk string, anchor long, n long", rows=1)


def _found(uri: str, wanted: np.ndarray) -> tuple[pa.Table, Words, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk, its words, and its stretches whose anchor is wanted."""
    rows, (hashes, first, n) = read_chunk(uri)
    own = np.isin(hashes.view("<i8"), wanted)
    return rows, Words(rows["text"].combine_chunks()), hashes.view("<i8")[own], first[own].astype(np.int64), n[own].astype(np.int64)


def chunk_stretches(asked: DataFrame, path: str, window: int) -> DataFrame:
    """Distinct stretches of each chunk whose anchors are asked for: chunk, anchor, id (digest), content, n (how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, hashes, first, size = _found(f"{path}/{row['chunk']}", np.array(row["anchors"], np.int64))[1:]
                seen: dict[bytes, int] = {}
                anchors, contents, counts = [], [], []
                for h, low, n in zip(hashes.tolist(), first.tolist(), size.tolist(), strict=True):
                    content = words.run(low, low + n + window - 1)
                    at = seen.setdefault(content, len(seen))
                    if at == len(contents):
                        anchors.append(h)
                        contents.append(content)
                        counts.append(0)
                    counts[at] += 1
                for low in range(0, len(contents), 4096):
                    own = slice(low, low + 4096)
                    yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]] * len(contents[own]), "anchor": anchors[own], "id": [xxhash.xxh3_128_digest(x) for x in contents[own]], "content": contents[own], "n": counts[own]})

    return common.map_arrow(asked, run, "chunk string, anchor long, id binary, content binary, n long", rows=1)


def repeated_windows(rows: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Which windows of distinct stretches (anchor, id, content, n) occur twice or more: id, bits (one for each window).

    Stretches of one anchor meet in one index. A task makes an index of about shard_words words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def shard(table: pa.Table) -> pa.RecordBatch:
            split = pc.ascii_split_whitespace(table["content"].combine_chunks().cast(pa.string()))
            coded = split.flatten().dictionary_encode()
            stops = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
            words = coded.indices.to_numpy().astype(np.int64) + 1
            index = FmIndex(np.insert(words, stops, 0), table["n"].to_numpy(), len(coded.dictionary) + 1)
            reached = index.matching_statistics(words, stops, 2, window, indexed=True) >= window
            starts = np.concatenate([[0], stops[:-1]])
            bits = np.zeros(len(stops), np.int64)
            for k in range(int((stops - starts).max()) - window + 1):
                at = np.minimum(starts + k, stops - 1)
                bits |= (reached[at] & (starts + k < stops)).astype(np.int64) << k
            hit = np.flatnonzero(bits)
            return pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(pa.array(hit)), pa.array(bits[hit])], names=["id", "bits"])

        for batch in batches:
            anchors = batch.column("anchor").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(anchors)]
            lengths = pc.binary_length(batch.column("content")).to_numpy()
            for low, high in zip(borders[:-1], borders[1:], strict=True):
                if low == high:
                    continue
                if size >= 5 * shard_words and anchors[low] != last:  # five bytes a word at least
                    yield shard(pa.Table.from_batches(held))
                    held, size = [], 0
                    common.release()
                held.append(batch.slice(low, high - low))
                size += int(lengths[low:high].sum())
                last = anchors[low]
        if held:
            yield shard(pa.Table.from_batches(held))

    # Stretches with a partner: alone under an anchor, one could only repeat inside itself, and then its anchor would too.
    dealt = rows.select("anchor", "id", "content", "n").repartition(common.partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor")
    return common.map_arrow(dealt, run, "id binary, bits long")


def _single_windows(rows: DataFrame, window: int) -> DataFrame:
    """Each window of stretches for itself: id (of the stretch), place, own (digest of the window), anchor, content, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["content"].split()
                contents = [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
                k = len(contents)
                anchors = [int.from_bytes(xxhash.xxh64_digest(x), "big", signed=True) for x in contents]
                yield pa.RecordBatch.from_pydict({"id": [row["id"]] * k, "place": list(range(k)), "own": [xxhash.xxh3_128_digest(x) for x in contents], "anchor": anchors, "content": contents, "n": [row["n"]] * k})

    return common.map_arrow(rows, run, "id binary, place long, own binary, anchor long, content binary, n long")


def find_repeats(stretch_rows: DataFrame, window: int, shard_words: int = SHARD_WORDS, hot: int = HOT_STRETCHES) -> DataFrame:
    """id and bits of all stretches with a repeated window; stretch_rows: anchor, id, content, n, an id in any number of rows."""
    distinct = common.cut(stretch_rows.groupBy("anchor", "id").agg(F.first("content").alias("content"), F.sum("n").alias("n")), "stretches")
    many = distinct.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor")
    many = common.cut(many, "hot")
    usual = repeated_windows(distinct.join(many, "anchor", "left_anti"), window, shard_words)
    single = common.cut(_single_windows(distinct.join(many, "anchor", "left_semi"), window), "windows")
    own = single.groupBy("anchor", "own").agg(F.first("content").alias("content"), F.sum("n").alias("n"))
    hits = repeated_windows(own.select("anchor", F.col("own").alias("id"), "content", "n"), window, shard_words).select(F.col("id").alias("own"))
    bits = single.join(hits, "own").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("bits"))
    return usual.unionByName(bits)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES, shard_words: int = SHARD_WORDS, hot: int = HOT_STRETCHES) -> DataFrame:
    """doc_id, n_words, kept (text of the words that stay, one space apart) and spans (removed words, as [from, to) pairs).

    A word goes if a window over it starts anywhere else too, in the same row or another. Only doc_id and text are read.
    Null and empty texts, and texts shorter than a window, keep all words. Repeated rows are copies of each other, so
    those of a window's length or more lose all words. A null doc_id stays null. An empty table stays empty.
    anchor must be shorter than window, and window at most 63 longer than anchor.
    """
    if not 0 < anchor < window <= anchor + 62:
        raise ValueError("an anchor is shorter than a window, by 62 words at most")
    spark = docs.sparkSession
    path = common.fresh_path(spark, "texts")
    chunks = common.cut(write_chunks(docs, path, window, anchor, chunk_bytes), "anchors")
    places = _anchor_rows(chunks)
    again = places.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    asked = places.join(again, "anchor").groupBy("chunk").agg(F.collect_list("anchor").alias("anchors"))  # those of one chunk
    # One row for each chunk: dealt out evenly, as each stands for a whole file.
    asked = asked.repartition(common.partitions(spark))
    found = common.cut(chunk_stretches(asked, path, window), "found")
    verdicts = find_repeats(found.select("anchor", "id", "content", "n"), window, shard_words, hot)
    hits = found.select("chunk", "anchor", "id").join(verdicts, "id").groupBy("chunk").agg(F.collect_list(F.struct("anchor", "id", "bits")).alias("hits"))
    tasks = chunks.select("chunk").join(hits, "chunk", "left").repartition(common.partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bits = {x["id"]: x["bits"] for x in row["hits"] or []}
                rows, words, _, first, size = _found(f"{path}/{row['chunk']}", np.array([x["anchor"] for x in row["hits"] or []], np.int64))
                own = np.fromiter((bits.get(xxhash.xxh3_128_digest(words.run(low, high)), 0) for low, high in zip(first.tolist(), (first + size + window - 1).tolist(), strict=True)), np.int64, len(first))
                change = np.zeros(len(words.starts) + 1, np.int64)
                for k in range(window - anchor + 1):  # each window is in one stretch
                    at = first[(own >> k) & 1 == 1] + k
                    change[at] += 1
                    change[at + window] -= 1
                gone = np.cumsum(change)[:-1] > 0
                yield from _kept(rows["doc_id"].combine_chunks(), words, gone)

    return common.map_arrow(tasks, run, "doc_id long, n_words long, kept string, spans array<array<long>>", rows=1)


def _kept(doc_ids: pa.Array, words: Words, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = 256
    for at in range(0, len(doc_ids), step):
        numbers, kept, spans = [], [], []
        for low, high in zip(words.first[at : at + step].tolist(), words.first[at + 1 : at + step + 1].tolist(), strict=False):
            own = gone[low:high]
            edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
            numbers.append(high - low)
            spans.append([*map(list, zip(edges[::2], edges[1::2], strict=True))])
            stays = [0, *edges, high - low]
            kept.append(b" ".join(words.run(low + i, low + j) for i, j in zip(stays[::2], stays[1::2], strict=True) if i < j).decode())
        yield pa.RecordBatch.from_arrays([doc_ids[at : at + step], pa.array(numbers, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_words", "kept", "spans"])


def op11_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows: doc_id, n_words, n_removed, kept_sha256."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span[1] - span[0])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
