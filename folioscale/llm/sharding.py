"""Operator 1: sharding by extendible hashing, with DataFrame operations only.

A row's path is the MD5 of its key, in bits, followed by the MD5 of its tie column: rows of one hot key part on the
tie's bits. A directory bucket is a path prefix. Buckets over the byte limit are split on one more bit until every one
fits. LEVEL bits are settled in one pass: bytes are summed by prefix before anything is shuffled, so a pass moves one
row for each prefix and task, and only prefixes that are still too large go to the next pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.llm import common

#: Bits settled in a pass: three hexadecimal digits.
LEVEL = 12
#: The limit of a shard that the registered query uses.
SHARD_BYTES = 32 << 20


def _path(key: str, tie: str | None, level: int) -> Column:
    """The first 3 * (level + 1) hexadecimal digits; those of the tie are computed only where they are asked for."""
    first = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    digits = 3 * (level + 1)
    if digits <= 30:
        return F.substring(first, 1, digits)
    rest = F.md5(F.coalesce(F.col(tie).cast("string"), F.lit(""))) if tie else F.lit("0" * 32)
    return F.concat(F.substring(first, 1, 30), F.substring(rest, 1, digits - 30))


def shard_directory(rows: DataFrame, max_bytes: int, size: str, key: str = "doc_id", tie: str | None = None) -> list[DataFrame]:
    """One table for each pass: cell (path prefix), open (goes on in the next pass) and its shard's columns."""
    tables: list[DataFrame] = []
    last = 19 if tie else 9
    for level in range(last + 1):
        cells = rows.select(_path(key, tie, level).alias("cell"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
        if tables:
            still = tables[-1].where("open").select(F.col("cell").alias("_parent"))
            cells = cells.join(still, F.substring("cell", 1, 3 * level) == F.col("_parent"), "left_semi")
        cells = cells.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        cells = cells.select("*", F.substring("cell", 1, 3 * level).alias("parent"), F.conv(F.substring("cell", 3 * level + 1, 3), 16, 10).cast("int").alias("digit"))
        # At most 4096 rows stand below a parent.
        prefix = {d: F.shiftright("digit", LEVEL - d) for d in range(LEVEL + 1)}
        sums = {d: Window.partitionBy("parent", prefix[d]) for d in prefix}
        first = 0 if level == 0 else 1  # the parent itself is known to be too large
        at = cells.select("*", *[F.sum("bytes").over(sums[d]).alias(f"b{d}") for d in range(first, LEVEL + 1)], *[F.sum("n").over(sums[d]).alias(f"n{d}") for d in range(first, LEVEL + 1)])
        fits = F.coalesce(*[F.when(F.col(f"b{d}") <= max_bytes, F.lit(d)) for d in range(first, LEVEL + 1)])
        depth = F.coalesce(fits, F.lit(LEVEL))
        bits = F.lpad(F.conv("cell", 16, 2), LEVEL, "0") if level == 0 else F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3 * (level + 1))), lambda i: F.lpad(F.conv(F.col("cell").substr(i, F.lit(1)), 16, 2), 4, "0")), "")
        choose = lambda name: reduce(lambda a, d: F.when(depth == d, F.col(f"{name}{d}")).otherwise(a), range(first, LEVEL), F.col(f"{name}{LEVEL}"))
        table = at.select(
            "cell",
            (fits.isNull() & F.lit(level < last)).alias("open"),
            bits.substr(F.lit(1), depth + LEVEL * level).alias("shard"),
            (depth + LEVEL * level).cast("int").alias("shard_depth"),
            choose("b").alias("shard_bytes"),
            choose("n").alias("shard_rows"),
        )
        tables.append(common.cut(table, "directory"))
        if tables[-1].where("open").isEmpty():
            break
    return tables


def assign_shards(rows: DataFrame, max_bytes: int = SHARD_BYTES, size: str = "size", key: str = "doc_id", tie: str | None = None) -> DataFrame:
    """Every row with shard (its bits as text), shard_depth, shard_bytes and shard_rows.

    A null key or tie counts as the empty text, a null size as 0. Rows that agree in key and tie stay together, even
    if they alone exceed the limit, as does a single row larger than it: such a shard is the only kind with
    shard_bytes over the limit. Input columns that carry one of the four names are replaced. An empty table stays
    empty.
    """
    added = ["shard", "shard_depth", "shard_bytes", "shard_rows"]
    slim = common.cut(rows.select(F.col(key).alias("_key"), *([F.col(tie).alias("_tie")] if tie else []), F.col(size).alias("_size")), "sizes")
    tables = shard_directory(slim, max_bytes, "_size", "_key", "_tie" if tie else None)
    kept = [c for c in rows.columns if c not in added]
    left = rows.select(*[F.col(f"`{c}`") for c in kept])
    placed = []
    for level, table in enumerate(tables):
        table = table.select(F.col("cell").alias("_cell"), F.col("open").alias("_open"), *added)
        if level == 0:
            table = F.broadcast(table)  # 4096 rows at most
        met = left.withColumn("_at", _path(key, tie, level)).join(table, F.col("_at") == F.col("_cell"))
        placed.append(met.where("not _open").select(*[F.col(f"`{c}`") for c in kept], *added))
        left = met.where("_open").select(*[F.col(f"`{c}`") for c in kept])
    return reduce(DataFrame.unionByName, placed)


def write_shards(rows: DataFrame, path: str, max_bytes: int = SHARD_BYTES, size: str = "size", key: str = "doc_id", tie: str | None = None) -> None:
    """Write rows as Parquet in one folder for each shard."""
    assigned = assign_shards(rows, max_bytes, size, key, tie)
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, shards of at most 32 MiB of text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("size"))
    return assign_shards(docs, SHARD_BYTES).select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "shard", "shard_depth", "shard_bytes", "shard_rows")


OP1_SQL = f"""
WITH h AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS path
  FROM documents),
d AS (SELECT doc_id, size, path, k, path >> CAST(60 - k AS BIGINT) AS prefix FROM h, (SELECT unnest(range(0, 41)) AS k)),
s AS (SELECT k, prefix, sum(size) AS bytes, count(*) AS n FROM d GROUP BY k, prefix),
f AS (SELECT d.doc_id, d.size, min(d.k) AS depth, any_value(d.path) AS path
      FROM d JOIN s ON d.k = s.k AND d.prefix = s.prefix WHERE s.bytes <= {SHARD_BYTES} GROUP BY d.doc_id, d.size)
SELECT f.doc_id, f.size, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(s.prefix), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS shard_depth, CAST(s.bytes AS BIGINT) AS shard_bytes, CAST(s.n AS BIGINT) AS shard_rows
FROM f JOIN s ON s.k = f.depth AND s.prefix = (f.path >> CAST(60 - f.depth AS BIGINT))
"""
