"""Immutable releases: tables written once, a manifest of counts and digests, one pointer that is switched, checks and repair."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.operators.ledger import order_free_digest
from folioscale.session import scratch_path, table


def _summary(name: str, df: DataFrame) -> DataFrame:
    rows = df.select(F.lit(name).alias("name"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row"))
    return order_free_digest(rows, ["name"], F.col("row"))


def write_release(spark: SparkSession, root: str, release_id: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Write each table and then the manifest (name, n, digest), without which a release does not exist."""
    base = f"{root}/releases/{release_id}"
    manifest = None
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}")
        own = _summary(name, spark.read.parquet(f"{base}/{name}"))
        empty = spark.createDataFrame([(name,)], "name string").join(own, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit("")).alias("digest"))
        manifest = empty if manifest is None else manifest.unionByName(empty)
    manifest.coalesce(1).write.parquet(f"{base}/_manifest_table")
    return spark.read.parquet(f"{base}/_manifest_table")


def violations(spark: SparkSession, root: str, release_id: str) -> DataFrame:
    """What differs from the manifest: name and problem (missing_table, count or digest). Empty: the release is valid."""
    base = f"{root}/releases/{release_id}"
    manifest = spark.read.parquet(f"{base}/_manifest_table")
    found = None
    for row in manifest.collect():  # a row for each table
        try:
            own = _summary(row.name, spark.read.parquet(f"{base}/{row.name}"))
        except Exception as problem:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            own = spark.createDataFrame([(row.name, -1, "")], "name string, n long, digest string")
        found = own if found is None else found.unionByName(own)
    met = manifest.join(found.withColumnsRenamed({"n": "_n", "digest": "_digest"}), "name", "left")
    n, digest = F.coalesce("_n", F.lit(0)), F.coalesce("_digest", F.lit(""))
    problem = F.when(n < 0, "missing_table").when(n != F.col("n"), "count").when(digest != F.col("digest"), "digest")
    return met.select("name", problem.alias("problem")).where("problem is not null")


def activate(spark: SparkSession, root: str, release_id: str, sequence: int, revoked: bool = False) -> None:
    """Append a control event; the pointer is the event with the greatest sequence, so readers see one or the other."""
    spark.createDataFrame([(sequence, release_id, revoked)], "sequence long, release_id string, revoked boolean").coalesce(1).write.mode("append").parquet(f"{root}/control")


def current(spark: SparkSession, root: str) -> str | None:
    """The release that the last control event names, or None if it revokes."""
    last = spark.read.parquet(f"{root}/control").agg(F.max_by(F.struct("release_id", "revoked"), "sequence").alias("e")).first()
    return None if last is None or last.e is None or last.e.revoked else last.e.release_id


def last_valid(spark: SparkSession, root: str) -> str | None:
    """The latest activated release without violations: what a repair goes back to."""
    events = spark.read.parquet(f"{root}/control").where("not revoked").groupBy("release_id").agg(F.max("sequence").alias("sequence")).orderBy(F.desc("sequence"))
    for row in events.collect():  # a row for each release
        if violations(spark, root, row.release_id).isEmpty():
            return row.release_id
    return None


def read(spark: SparkSession, root: str, release_id: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/releases/{release_id}/{name}")


def pin(spark: SparkSession, root: str) -> str:
    """The release to read from, fixed for all of a query's reads."""
    release_id = current(spark, root)
    if release_id is None:
        raise ValueError("no release is active")
    return release_id


def q_release_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two releases of all documents; the second gets every row once more than its manifest says, so a reader gets the first."""
    root = scratch_path(spark, "releases")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    for number, name in enumerate(("r1", "r2"), 1):
        write_release(spark, root, name, {"documents": docs, "labels": labels})
        activate(spark, root, name, number)
    docs.write.mode("append").parquet(f"{root}/releases/r2/documents")
    if not violations(spark, root, pin(spark, root)).isEmpty():
        activate(spark, root, last_valid(spark, root), 3)
    return read(spark, root, pin(spark, root), "documents").groupBy("lang").agg(F.count("*").alias("n"))


QUERIES = {"release_round_trip": q_release_round_trip}
ORACLES = {"release_round_trip": "SELECT lang, count(*) AS n FROM documents GROUP BY lang"}
