"""Streams: incremental ingest by micro-batches, and windowed counts under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.operators.lexical import build_index
from folioscale.plans.commits import Store
from folioscale.session import kept, scratch_path, table


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; on a stream, what comes later than allowed is left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late and events.isStreaming else rows
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_to_end(stream: DataFrame, path: str, mode: str = "complete") -> None:
    """Run a stream over all that there is; each batch replaces (complete) or adds to the table at path."""
    write = lambda batch, number: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-progress").foreachBatch(write).start()
    query.awaitTermination()


def index_stream(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Keep an index of documents (key, text) as they arrive; read it with stream_index.

    What the index has is a table of its own: key, digest of the text and the batch it came with. A document that comes
    again unchanged is passed over; a changed one is built anew, and its older postings no longer count. Of several
    versions in one batch one stays, that with the greatest digest. A batch that is tried again replaces its own folders
    and looks at earlier batches only, so it does what it did before.
    """
    spark = docs.sparkSession

    def build(batch: DataFrame, number: int) -> None:
        own = batch.select(key, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).groupBy(key).agg(F.max("sha").alias("sha"), F.max_by("text", "sha").alias("text"))
        if number and Store(spark, path).exists("seen"):
            last = latest(spark.read.parquet(f"{path}/seen").where(F.col("batch") < number), key).select(F.col(key).alias("_key"), F.col("sha").alias("_sha"))
            own = own.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("sha") == F.col("_sha")), "left_anti")
        fresh = kept(own, "fresh")
        windows, postings = build_index(fresh, key)
        for name, rows in (("windows", windows), ("postings", postings), ("seen", fresh.select(key, "sha"))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    docs.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/progress").foreachBatch(build).start().awaitTermination()


def latest(seen: DataFrame, key: str) -> DataFrame:
    """key, sha and batch of the last version of each document."""
    return seen.groupBy(key).agg(F.max_by("sha", "batch").alias("sha"), F.max("batch").alias("batch"))


def stream_index(spark: SparkSession, path: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(windows, postings) of the last version of every document that a stream has brought."""
    live = latest(spark.read.parquet(f"{path}/seen"), key).select(F.col(key).alias("_key"), F.col("batch").alias("_batch"))
    of_last = lambda rows: rows.join(live, F.col("key").eqNullSafe(F.col("_key")) & (F.col("batch") == F.col("_batch")), "left_semi").drop("batch")
    return of_last(spark.read.parquet(f"{path}/windows")), of_last(spark.read.parquet(f"{path}/postings"))


def q_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


def q_stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream")
    events = file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    run_to_end(windowed_counts(events), path)
    return spark.read.parquet(path).withColumn("total", F.round("total", 4))


def q_stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a stream brings twice, under two names, and its index as it is then."""
    path, folder = scratch_path(spark, "stream"), scratch_path(spark, "arrivals")
    docs = table(spark, sf, "documents")
    for name in ("first", "again"):
        docs.write.parquet(f"{folder}/{name}")
        arrivals = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
        index_stream(arrivals, path)
    return stream_index(spark, path)[1].groupBy("term").agg(F.count("*").alias("windows"), F.sum("tf").alias("tokens"))


_SQL = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
QUERIES = {"event_windows": q_event_windows, "stream_event_windows": q_stream_event_windows, "stream_index": q_stream_index}
ORACLES = {
    "event_windows": _SQL,
    "stream_event_windows": _SQL,
    "stream_index": "WITH w AS (SELECT doc_id, s, substr(text, CAST(s + 1 AS BIGINT), 1800) AS w FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 1560)) AS s FROM documents)), e AS (SELECT doc_id, s, unnest(regexp_extract_all(lower(w), '[\\p{L}\\p{N}]+')) AS term FROM w), p AS (SELECT doc_id, s, term, count(*) AS tf FROM e GROUP BY ALL) SELECT term, count(*) AS windows, CAST(sum(tf) AS BIGINT) AS tokens FROM p GROUP BY term",
}
