"""Cutting lineage through the shared folder, and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint folder.

    Only a local master without one gets a temporary folder; a cluster must name its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="vecloom-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, survives lost executors.

    What its shuffles left on the executors' disks goes with the write: nothing reads them again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables from ``stored`` that nothing will read again."""
    for df in tables:
        drop_folder(df.sparkSession, df.stored_path)


def drop_folder(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fetch_bounded(df: DataFrame, max_rows: int):
    """Arrow table of ``df`` if it holds at most ``max_rows`` rows, else None."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def small_or_same(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` as a local table marked for broadcast when its size, checked here, allows; else stored."""
    table = fetch_bounded(df, max_rows)
    if table is None or table.nbytes > max_bytes:
        return stored(df, "table")
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for shuffles that feed Python arithmetic: the session's setting, uncoalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
