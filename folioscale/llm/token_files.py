"""Operator 10: token ids written as patched frame-of-reference files, and read back.

Documents are dealt by ranges of doc_id (a hash of the text splits a repeated doc_id), so each task writes files of
consecutive documents; files roll at FILE_IDS ids. The tasks' rows form a manifest: only files it names count, so a
second attempt of a task leaves nothing behind that would be read. Reading goes through Spark's binary file source.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.llm import common, pfor
from folioscale.llm.token_ids import default_tokenizer, part_encoder

#: Ids of a file at most, but for a single longer document.
FILE_IDS = 2_000_000
MANIFEST = "part long, seq long, file string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1, block: int = pfor.BLOCK, share: float = 0.9, file_ids: int = FILE_IDS) -> DataFrame:
    """Write doc_id and text of docs (other columns are left alone) and return the manifest table.

    A null text is empty and holds the end id only. Null doc_ids come first. Repeated doc_ids and repeated rows are
    all written, in an order that depends on their texts only. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    path = path or common.fresh_path(spark, "tokens")
    tokenizer = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        encode = part_encoder(tokenizer)
        doc_ids, counts, held, size, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, counts, held, size, seq
            file = f"{part:06d}-{seq:05d}-{attempt}.pfr"
            common.write_file(f"{path}/{file}", pfor.encode_file(doc_ids, counts, np.concatenate(held), block, share))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [file], "n_docs": [len(doc_ids)], "n_ids": [size]})
            doc_ids, counts, held, size, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            ids, sizes = encode(batch.column("text"), end_id)
            names, ends = batch.column("doc_id").to_pylist(), np.cumsum(sizes)
            at = 0
            while at < len(names):  # a file rolls behind the first document that fills it
                stop = min(len(names), int(np.searchsorted(ends, file_ids - size + (ends[at - 1] if at else 0))) + 1)
                part_of = ids[ends[at - 1] if at else 0 : ends[stop - 1]]
                doc_ids += names[at:stop]
                counts += sizes[at:stop].tolist()
                held.append(part_of)
                size, at = size + len(part_of), stop
                if size >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    # The number is given so that Spark never merges partitions by size: a merged task would hold more files, not more memory.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(common.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = common.map_arrow(dealt.select("doc_id", "text"), write, MANIFEST)
    # Parts are in the order of doc_id; the window sees one row for each file.
    placed = common.cut(manifest, "manifest")
    return placed.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("path", F.lit(path))


def read_token_files(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Documents of the manifest's files: doc_id, start (ids of all documents before), n_tokens, ids (binary)."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, start in zip(batch.column("content"), batch.column("start").to_pylist(), strict=True):
                found = pfor.TokenFile(payload.as_buffer())
                ids = np.ascontiguousarray(found.ids().astype("<u4"))
                ends = np.cumsum(found.counts)
                begins = ends - found.counts
                for low in range(0, len(ends), 4096):
                    part = slice(low, low + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.doc_ids[part], mask=found.nulls[part]),
                            pa.array(begins[part] + start),
                            pa.array(found.counts[part]),
                            common.binary_array(ids[begins[part][0] : ends[part][-1]], 4 * (ends[part] - begins[part][0])),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(path)
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).select("file", "content")
    kept = named.join(F.broadcast(manifest.select("file", "start")), "file")  # one row for each file of 2 million ids
    return common.map_arrow(kept.select("content", "start"), read, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back: doc_id, start, n_tokens, ids_crc32."""
    path = common.fresh_path(spark, "tokens")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
