"""Operator 8: near-duplicates by SimHash, found through per-segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two bits; the bit counts of the segments, 0 to 2 each, are a point
whose Manhattan distance to another is never above the Hamming distance. Fingerprints with at most four differing bits
thus lie within distance 2 in the first or in the second half of the segments, and then share a grid cell at distance
1 or less from both. Each distinct fingerprint is sent to those cells; inside a cell the pairs are verified exactly.
A cell is read as a sorted run, and what leaves a task is a spanning forest of its verified links, never all pairs.
Cells beyond RUN fingerprints are split into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from folioscale.llm import common
from folioscale.llm.components import components, local_roots

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints of a cell that are compared in one piece.
RUN = 4096
_HALF = 16
_POWERS = 3 ** np.arange(_HALF, dtype=np.int64)


def _counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of each run of size words joined by a space; of the whole list if it is shorter."""
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint_of(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one text, in bounded memory: words are read in blocks that overlap by a shingle."""
    total, ones, held = 0, np.zeros(64, np.int64), []
    for words in common.word_blocks(text.lower()):
        held += words
        if len(held) >= size:
            hashes = shingle_hashes(held, size)
            ones += _counts(np.array(hashes, np.uint64)).sum(0, dtype=np.int64)
            total += len(hashes)
            held = held[len(held) - size + 1 :]
    if not total and held:
        hashes = shingle_hashes(held, size)
        ones, total = _counts(np.array(hashes, np.uint64)).sum(0, dtype=np.int64), 1
    return int("".join("1" if 2 * x > total else "0" for x in ones), 2) if total else 0


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a batch of texts, as unsigned numbers; long texts one at a time."""
    out, short, hashes, sizes = np.zeros(len(texts), np.uint64), [], [], []

    def settle() -> None:
        if short:
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ones = np.add.reduceat(_counts(np.array(hashes, np.uint64)), starts, axis=0, dtype=np.int32)
            bits = 2 * ones > np.array(sizes)[:, None]
            out[short] = np.packbits(bits, axis=1).view(">u8").ravel()
        for held in (short, hashes, sizes):
            held.clear()

    for i, text in enumerate(texts):
        if len(text) > 1 << 18:
            out[i] = fingerprint_of(text, size)
        elif own := shingle_hashes(text.lower().split(), size):
            short.append(i)
            hashes += own
            sizes.append(len(own))
            if len(hashes) > 1 << 17:
                settle()
    settle()
    return out


def fingerprint_column(text: str = "text", size: int = SHINGLE):
    """The fingerprint of a text column as a signed long; a null text is empty, a text without words has zero."""

    @arrow_udf("long")
    @common.released
    def fingerprint(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints(common.text_bytes(column), size).view(np.int64))

    return fingerprint(F.col(text).cast("string"))


def cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every grid cell within distance 1 of each print, in each half, and the print it belongs to."""
    value = prints.view(np.uint64)
    pairs = (value & np.uint64(0x5555555555555555)) + (value >> np.uint64(1) & np.uint64(0x5555555555555555))
    counts = (pairs[:, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3)).astype(np.int64)
    found, owner = [], []
    for half in range(2):
        own = counts[:, half * _HALF : (half + 1) * _HALF]
        center = own @ _POWERS + half * 3**_HALF
        found.append(center)
        owner.append(prints)
        for step, fits in ((1, own < 2), (-1, own > 0)):
            row, segment = np.nonzero(fits)
            found.append(center[row] + step * _POWERS[segment])
            owner.append(prints[row])
    return np.concatenate(found), np.concatenate(owner)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= distance


def _pairs(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links among the prints of one run: the search goes from seed to reached ones."""
    left, out_a, out_b = prints, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            parent = np.zeros(len(left), np.int64)
            for low in range(0, len(front), 512):
                part = front[low : low + 512]
                met = _near(part[:, None], left[None, :], distance)
                new = met.any(0) & ~near
                parent[new] = part[met[:, new].argmax(0)]
                near |= new
            out_a.append(parent[near])
            out_b.append(left[near])
            front, left = left[near], left[~near]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def links_in_runs(cell: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between prints of the same cell, cells being in runs, reduced to their components' stars."""
    if not len(cell):
        return prints[:0], prints[:0]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    out_a, out_b = [prints[:0]], [prints[:0]]
    for at in np.flatnonzero(sizes > 64):
        a, b = _pairs(np.unique(prints[starts[at] : starts[at] + sizes[at]]), distance)
        out_a.append(a)
        out_b.append(b)
    left = np.repeat(np.where(sizes > 64, 0, starts + sizes), sizes)  # where a short run ends
    here = np.flatnonzero(left > np.arange(len(cell)) + 1)
    step = 1
    while len(here):
        near = _near(prints[here], prints[here + step], distance)
        out_a.append(prints[here[near]])
        out_b.append(prints[here[near] + step])
        step += 1
        here = here[here + step < left[here]]
    return local_roots(np.concatenate(out_a), np.concatenate(out_b))


_FOUND = "hot boolean, a long, b long"


def _batch(hot: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a), pa.array(b)], names=["hot", "a", "b"])


def _link_runs(distance: int, run: int | None):
    """Reads rows of cell and print sorted by cell. Runs beyond run are handed on as they are: hot, cell, print."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        passing = None  # the cell of a run that is being handed on
        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            if passing is not None:
                own = cell == passing
                if own.any():
                    yield _batch(True, cell[own], prints[own])
                    cell, prints = cell[~own], prints[~own]
            if not len(cell):
                continue
            passing = None
            last = np.searchsorted(cell, cell[-1])  # the last run may go on
            if last:
                yield from given(cell[:last], prints[:last])
            cell, prints = cell[last:], prints[last:]
            if run and len(cell) > run:
                passing = cell[0]
                yield _batch(True, cell, prints)
                cell, prints = cell[:0], prints[:0]
        if len(cell):
            yield from given(cell, prints)

    def given(cell: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if run:
            _, at, sizes = np.unique(cell, return_inverse=True, return_counts=True)
            large = sizes[at] > run
            if large.any():
                yield _batch(True, cell[large], prints[large])
                cell, prints = cell[~large], prints[~large]
        a, b = links_in_runs(cell, prints, distance)
        if len(a):
            yield _batch(False, a, b)

    return link


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE, run: int = RUN) -> DataFrame:
    """a, b: links of a table of distinct fingerprints (column fp), enough of them to join every component.

    The grid holds for distances up to 4.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the grid finds distances from 0 to 4")
    spark = prints.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for low in range(0, len(values), 4096):
                cell, owner = cells(values[low : low + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(owner)], names=["cell", "fp"])

    dealt = common.map_arrow(prints.select("fp"), spread, "cell long, fp long").repartition(common.partitions(spark), "cell").sortWithinPartitions("cell")
    found = common.cut(common.map_arrow(dealt, _link_runs(distance, run), _FOUND), "links")
    links, hot = found.where("not hot").select("a", "b"), found.where("hot").select(F.col("a").alias("cell"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return links
    blocks = hot.groupBy("cell").agg(F.ceil(2 * F.count("*") / run).cast("int").alias("blocks"))
    dealt = hot.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(task.alias("task"), "fp").repartition(common.partitions(spark), "task").sortWithinPartitions("task")
    more = common.cut(common.map_arrow(dealt, _link_runs(distance, None), _FOUND), "links")
    return links.union(more.select("a", "b"))


def fingerprint_groups(slim: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, root and component_id (the smallest doc_id) for every fingerprint of a table of doc_id and fp."""
    classes = common.cut(slim.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(fingerprint_links(classes, distance))
    grouped = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return common.cut(grouped.select("fp", "root").join(least, "root"), "groups")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, text: str = "text") -> DataFrame:
    """doc_id, fp (signed), fingerprint (hexadecimal), root and component_id of every row of docs.

    A null text is empty; texts without words have fingerprint zero and are linked like others. Rows that repeat are
    rows of one group. A null doc_id is never a component_id unless the whole group has none. An empty table has no rows.
    """
    common.bound_batches(docs.sparkSession)
    slim = common.cut(docs.select("doc_id", fingerprint_column(text).alias("fp")), "prints")
    groups = fingerprint_groups(slim, distance)
    return slim.join(groups, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, text: str = "text") -> DataFrame:
    """One document of each group, that with the smallest doc_id, with the columns of docs. Same cases as near_duplicates."""
    common.bound_batches(docs.sparkSession)
    masked, at = common.masked(docs)
    held = common.cut(masked.select("*", fingerprint_column(at[text]).alias("fp")), "printed")
    slim = held.select(F.col(at["doc_id"]).alias("doc_id"), "fp")
    groups = fingerprint_groups(slim, distance)
    first = slim.join(groups, "fp").where("doc_id <=> component_id").groupBy("root").agg(F.min("fp").alias("fp"), F.first("component_id").alias("component_id"))
    first = common.cut(first.select("fp", F.col("component_id").alias("id")), "first")
    kept = held.join(first, (held["fp"] == first["fp"]) & F.col(at["doc_id"]).eqNullSafe(F.col("id"))).select(*masked.columns, first["fp"])
    if slim.join(first, (slim["fp"] == first["fp"]) & slim["doc_id"].eqNullSafe(F.col("id"))).count() > first.count():
        kept = kept.dropDuplicates(["fp"])  # rows that repeat both doc_id and fingerprint
    return kept.select(*masked.columns).toDF(*docs.columns)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and near-duplicate group."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
