"""Operator 9: sum-of-squares packing of documents into sequences of a fixed length.

Each task packs the pieces it reads one after the other. A piece goes to the open bin, or to a new one, for which the
sum over all gaps of the squared number of open bins with that gap becomes smallest. Only that count for each gap and
the pieces of bins that are still open are kept; a full bin is given out at once. What stands in open bins at the end
of a task, a few hundred bins whatever it read, is packed again together with that of other tasks, in fewer and fewer
tasks; the last few pieces are placed largest first, each where it fits best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from folioscale.llm import common
from folioscale.llm.token_ids import default_tokenizer, part_encoder

CAPACITY = 4096
#: Pieces of open bins that one task packs in a later pass, and of the last pass.
PASS_ROWS = 100_000
_NEVER = np.int64(1) << 40


class SumOfSquares:
    """Online packing into bins of one capacity; put() returns the bin, its filled part before, and if it is full now."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def put(self, size: int) -> tuple[int, int, bool]:
        top, counts = self.capacity, self.open
        fresh = 2 * counts[top - size] + 1 if size < top else np.int64(-1)
        gap = top
        if size < top:
            own = counts[size:top]
            change = np.where(own > 0, counts[: top - size] - own, _NEVER)
            at = int(change.argmin())
            # Into gap == size the bin is full: it leaves the sum and nothing joins it (counts[0] stays 0).
            if change[at] < _NEVER and 2 * change[at] + (2 if at else 1) <= fresh:
                gap = size + at
        if gap == top:
            number = self.made
            self.made += 1
        else:
            counts[gap] -= 1
            number = self.bins[gap].pop()
        if gap > size:
            counts[gap - size] += 1
            self.bins[gap - size].append(number)
        return number, top - gap, gap == size


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, the largest first, each in the fullest bin that still holds it."""
    counts = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        fitting = counts[size:] > 0
        at = int(fitting.argmax())
        if fitting[at]:
            gap = size + at
            counts[gap] -= 1
            number = bins[gap].pop()
        else:
            gap, number = capacity, made
            made += 1
        where[k], offset[k] = number, capacity - gap
        counts[gap - size] += 1
        bins[gap - size].append(number)
    return where, offset


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    A document is its ids and the end id; only longer ones are cut, into pieces of the capacity, and the last may be
    shorter. A null text is empty. Every row is a document of its own, also one that repeats or has no doc_id. Other
    columns are left alone. An empty table has no pieces.
    """
    tokenizer = tokenizer or default_tokenizer()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = part_encoder(tokenizer)
        for batch in batches:
            ids, counts = encode(batch.column("text"), end_id)
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
            start = piece * capacity
            length = np.minimum(capacity, counts[owner] - start)
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), common.binary_array(ids, 4 * np.cumsum(length))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, cut_up, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Pieces with sequence_id and offset (both long), gapless from 0 in each sequence.

    All other columns of pieces are kept; columns of those two names are replaced. A piece longer than the capacity
    has a sequence of its own. A null length or one under 1 takes no room: sequence_id and offset are null. Repeated
    rows are pieces of their own. An empty table stays empty.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows, at = common.masked(pieces.select(*[F.col(f"`{c}`") for c in kept]))
    masked, size_of = rows.columns, at[length]
    fields = StructType([*rows.schema.fields, StructField("pass", IntegerType()), StructField("open", BooleanType()), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = [*masked, "pass", "open", "sequence_id", "offset"]

    def run(number: int, last: bool):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            base = (number << 56) + (TaskContext.get().partitionId() << 32)
            packer = SumOfSquares(capacity)
            held: dict[int, list[tuple[pa.RecordBatch, int, int]]] = {}  # of open bins: a row's batch, its place there, its offset

            def given(parts: list[tuple[pa.RecordBatch, int, int | None, int | None]], still_open: bool) -> Iterator[pa.RecordBatch]:
                by: dict[int, list] = {}
                for part in parts:
                    by.setdefault(id(part[0]), []).append(part)
                for own in by.values():
                    taken = own[0][0].take(pa.array([x[1] for x in own], pa.int32()))
                    n = len(own)
                    more = [pa.array([number] * n, pa.int32()), pa.array([still_open] * n), pa.array([None if x[2] is None else base + x[2] for x in own], pa.int64()), pa.array([x[3] for x in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=names)

            if last:  # at most PASS_ROWS rows
                whole = [*batches]
                if not whole:
                    return
                table = pa.Table.from_batches(whole).combine_chunks()
                if not table.num_rows:
                    return
                where, offset = best_fit_decreasing(table.column(size_of).to_numpy().astype(np.int64), capacity)
                columns = [table.column(c) for c in masked] + [pa.array(np.full(len(where), number, np.int32)), pa.array(np.zeros(len(where), bool)), pa.array(base + where), pa.array(offset)]
                yield from pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()
                return
            for batch in batches:
                done = []
                for i, size in enumerate(batch.column(size_of).to_pylist()):
                    if size is None or size < 1:
                        done.append((batch, i, None, None))
                    elif size > capacity:
                        done.append((batch, i, packer.made, 0))
                        packer.made += 1
                    else:
                        bin_number, offset, full = packer.put(int(size))
                        held.setdefault(bin_number, []).append((batch, i, offset))
                        if full:
                            done += [(x, j, bin_number, o) for x, j, o in held.pop(bin_number)]
                yield from given(done, False)
                # Of this batch only the rows of open bins stay in memory.
                left = [(b, k) for b, parts in held.items() for k, x in enumerate(parts) if x[0] is batch]
                slim = batch.take(pa.array([held[b][k][1] for b, k in left], pa.int32()))
                for j, (b, k) in enumerate(left):
                    held[b][k] = (slim, j, held[b][k][2])
            yield from given([(x, j, b, o) for b, parts in held.items() for x, j, o in parts], True)

        return place

    number, placed, before = 0, [], None
    while True:
        out = common.cut(common.map_arrow(rows, run(number, False), fields), "packed")
        placed.append(out.where("not open").drop("pass", "open"))
        rows = out.where("open").select(*masked)
        left = rows.count()
        if not left:
            break
        number += 1
        tasks = -(-left // PASS_ROWS)
        if tasks == 1 or left == before:  # no pass can make fewer open pieces out of pieces that none fits
            out = common.cut(common.map_arrow(rows.repartition(tasks), run(number, True), fields), "packed")
            placed.append(out.drop("pass", "open"))
            break
        before = left
        rows = rows.repartition(tasks)
    result = placed[0]
    for more in placed[1:]:
        result = result.unionByName(more)
    return result.toDF(*kept, "sequence_id", "offset")


def fill_sequences(placed: DataFrame) -> DataFrame:
    """The sequences' ids, from placed pieces that carry theirs: sequence_id, length, ids. A sequence's size is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda held, part: F.concat(held, part["ids"]))
    return placed.where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces are written without their ids first: a task then runs either the tokenizer or the packer, not both.
    """
    pieces = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(common.cut(pieces, "pieces"))
