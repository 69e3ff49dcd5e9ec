"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch handed to Python: a batch of long texts is no larger than one of short ones.
ARROW_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/folioscale/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it again: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, alike for every operator; a bound that the session has already stays."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(ARROW_BYTES))


def release() -> None:
    """Give memory that a worker no longer uses back to the machine: workers wait for the next stage with what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def released(function):
    """A function of one Arrow column that gives memory back after large batches."""

    @functools.wraps(function)
    def run(column: pa.Array) -> pa.Array:
        out = function(column)
        if column.nbytes > ARROW_BYTES // 4:
            release()
        return out

    return run


def map_arrow(df: DataFrame, function, schema: str, rows: int | None = None) -> DataFrame:
    """mapInArrow with batches of ARROW_BYTES bytes at most, but for a single longer row, and of so many rows at most."""
    bound_batches(df.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                yield batch.slice(low, rows or batch.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(sliced(batches))
        release()

    return df.mapInArrow(run, schema)


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns renamed _0, _1, ..., which no operator uses, and where each name went; toDF(*df.columns) renames back."""
    hidden = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*hidden), dict(zip(df.columns, hidden, strict=True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, for tasks that write or read whole files of the shared folder."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, payload: bytes) -> None:
    """Write a file and then move it into place, so that a reader or a second attempt never sees half of it."""
    files, path = store(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.part-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(payload)
    files.move(part, path)


@contextlib.contextmanager
def mapped_file(uri: str) -> Iterator[memoryview]:
    """A file of the shared folder, memory-mapped; one of a remote store is fetched first and removed afterwards."""
    import mmap

    files, path = store(uri)
    local = None
    if not isinstance(files, fs.LocalFileSystem):
        handle, local = tempfile.mkstemp(prefix="folioscale-")
        with os.fdopen(handle, "wb") as out, files.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                out.write(block)
        path = local
    try:
        with open(path, "rb") as source:
            yield memoryview(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ))
    finally:
        if local:
            os.unlink(local)


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text in order, in lists that cover about size bytes each: long texts need bounded memory."""
    if len(text) <= size:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column over a buffer, without a copy; ends: where in it, in bytes, each value stops."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def n_words(text: str = "text"):
    """Native count of words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
