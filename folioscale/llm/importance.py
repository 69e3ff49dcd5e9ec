"""Operator 12: documents resampled towards a target distribution by hashed n-gram importance weights.

Each batch interns its n-grams in an open-addressed table: a slot keeps an n-gram's bucket and its count, so buckets are
found once for each distinct n-gram, and gains are gathered by the slot ids of the occurrences. Bucket counts are summed
by Spark; only the table of gains, one number for each of N_BUCKETS, goes to the tasks. Ranks come from ranges of the
score, each ordered for itself.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm import common
from folioscale.llm.interning import SlotTable

#: Buckets (a bound of the gains that every task holds), longest run of words, share of the documents in percent, words a drawn document has at least, and the seed of the noise.
N_BUCKETS, LONGEST, PERCENT, MIN_WORDS, SEED = 10_000, 1, 10, 20, 2024
_END = 0xFF  # never part of UTF-8
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


class Features:
    """Runs of 1 to `longest` consecutive words of a column of texts (null: none), interned; owner: the text of each occurrence."""

    def __init__(self, column: pa.Array, longest: int, n_buckets: int):
        texts = common.text_bytes(column)
        data = np.frombuffer(bytes([_END]).join([*texts, b""]).translate(_FOLD), np.uint8)
        inner = (data != 32) & (data != _END)
        before = np.concatenate([[False], inner[:-1]])
        # Words one space apart, so that a run of words is a slice.
        data_kept = inner | before | (data == _END)
        flat = data[data_kept]
        inner, before = inner[data_kept], np.concatenate([[False], inner[data_kept][:-1]])
        starts, stops = np.flatnonzero(inner & ~before), np.flatnonzero(before & ~inner)
        text_of = np.cumsum(flat == _END)[starts] if len(starts) else np.zeros(0, np.int64)
        self.n_words = np.bincount(text_of, minlength=len(texts))
        begins, ends, owners = [starts], [stops], [text_of]
        for n in range(2, longest + 1):
            own = np.flatnonzero(text_of[: max(0, len(starts) - n + 1)] == text_of[n - 1 :])
            begins.append(starts[own])
            ends.append(stops[own + n - 1])
            owners.append(text_of[own])
        begin, end = np.concatenate(begins), np.concatenate(ends)
        self.owner = np.concatenate(owners)
        self.table = SlotTable(flat, begin, end - begin)
        raw = flat.tobytes()
        self.bucket = np.array([zlib.crc32(raw[i:j]) % n_buckets for i, j in zip(begin[self.table.owner].tolist(), end[self.table.owner].tolist(), strict=True)], np.int64)

    def bucket_counts(self, n_buckets: int) -> np.ndarray:
        return np.bincount(self.bucket, self.table.count, n_buckets).astype(np.int64)

    def per_text(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each text, and the sum of their gains."""
        n = len(self.n_words)
        return np.bincount(self.owner, minlength=n), np.bincount(self.owner, gains[self.bucket][self.table.slot], n).astype(np.int64)


def bucket_totals(docs: DataFrame, text: str = "text", longest: int = LONGEST, n_buckets: int = N_BUCKETS) -> DataFrame:
    """Features of all texts by bucket: bucket, n. Buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            total += Features(batch.column(0), longest, n_buckets).bucket_counts(n_buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    return common.map_arrow(docs.select(F.col(f"`{text}`").cast("string")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: a thousandth of a natural logarithm, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, in thousandths, from a digest of its number."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _dense(totals: DataFrame, n_buckets: int) -> np.ndarray:
    out = np.zeros(n_buckets, np.int64)
    for bucket, n in totals.collect():  # n_buckets rows at most
        out[bucket] = n
    return out


def score(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of docs."""
    n_buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Features(batch.column("text"), longest, n_buckets)
            n_features, weight = found.per_text(gains)
            more = np.array([noise(x, seed) for x in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (found.n_words, n_features, weight, weight + more)]], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST, n_buckets: int = N_BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; those drawn have a rank, from 1 on.

    target has a column text. Drawn are the highest scores of rows with at least min_words words, percent of their
    number, rounded down; of equal scores the smaller doc_id comes first, a null one last. Repeated rows are drawn each
    for itself, in any order among themselves. Null and empty texts have no features and a weight of 0. Other columns
    are left alone. An empty docs gives an empty table, an empty target gains that only depend on docs.
    """
    source = _dense(bucket_totals(docs, "text", longest, n_buckets), n_buckets)
    gains = gains_of(source, _dense(bucket_totals(target, "text", longest, n_buckets), n_buckets))
    scored = common.cut(score(docs, gains, longest, seed), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    n_drawn = able.count() * percent // 100
    keys = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ordered = able.repartitionByRange(common.partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    # Written once with their places, so that a second attempt of a task can't deal them anew.
    row = F.monotonically_increasing_id()
    placed = common.cut(ordered.withColumn("part", F.shiftright(row, 33)).withColumn("place", row.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    before, starts = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # one row for each range
        starts.append((part, before))
        before += n
    start = F.broadcast(docs.sparkSession.createDataFrame(starts, "part long, start long"))
    ranked = placed.join(start, "part").withColumn("rank", F.col("start") + F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*columns, F.when(F.col("rank") <= n_drawn, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.filter(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark, and the rank of those drawn: doc_id, n_features, weight, score, rank."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
