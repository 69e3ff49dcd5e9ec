"""Session construction and table loading shared by every entry point."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "folioscale", cores: str = "*", shuffle: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and single-node runs; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.environ.get("FOLIOSCALE_WAREHOUSE", "/tmp/folioscale-warehouse"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it; clusters ship it as usual."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or an own one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/folioscale/{kind}-{uuid.uuid4().hex}"


_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def kept(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read again, for what is used several times."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    if (own := _written.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """What is kept inside goes at the end: for a job whose results have been written elsewhere by then. Gives the paths."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)
        for path in paths:
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
