"""Saving and loading a point set with its graph, labels, tags and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import Version, VersionedTables


def save_snapshot(spark: SparkSession, path: str, version: int, tables: dict[str, DataFrame]) -> None:
    """Write each table under its version, then the row counts that make the version complete."""
    counts = []
    for name, df in tables.items():
        where = f"{path}/{name}/version={version}"
        df.write.mode("overwrite").parquet(where)
        counts.append((name, version, spark.read.parquet(where).count()))
    manifest = spark.createDataFrame(counts, "name string, version long, n long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={version}")


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of one version (the newest by default), after their counts have been checked."""
    manifest = spark.read.parquet(f"{path}/manifest")
    if version is None:
        version = manifest.agg(F.max("version")).first()[0]
    rows = manifest.where(F.col("version") == version).collect()
    if not rows:
        raise ValueError(f"no snapshot of version {version}")
    tables = {r.name: spark.read.parquet(f"{path}/{r.name}/version={version}") for r in rows}
    for r in rows:
        n = tables[r.name].count()
        if n != r.n:
            raise ValueError(f"{r.name} has {n} rows, {r.n} were saved")
    _agree(tables)
    return tables


def save_delta_snapshot(
    spark: SparkSession, path: str, version: int, tables: dict[str, tuple[str, DataFrame]], buckets: int = 64,
) -> dict[str, int]:
    """Save ``{name: (key, rows)}`` as a version that shares all unchanged buckets with the newest one before.

    Rows are in buckets by the hash of their key, which may repeat. Returns how many buckets of each table were written. A version is
    there once its last, single file is; saving one again replaces it.
    """
    layout = {name: (key, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)) for name, (key, df) in tables.items()}
    store = VersionedTables(spark, path, layout, buckets)
    store.create({"layout": layout, "buckets": buckets})
    before = store.version(max(n for n in store.numbers() if n < version))
    if before.notes["layout"] != {k: list(v) for k, v in layout.items()} or before.notes["buckets"] != buckets:
        raise ValueError("the tables, their columns or the number of buckets differ from the snapshots before")
    now, written = Version(version, before.gens, before.next_gen, before.notes), {}
    for name, (_, df) in tables.items():
        gen = now.next_gen
        now = store.replace(now, name, df)
        written[name] = sum(g == gen for g in now.gens[name])
    store.publish(now)
    return written


def load_delta_snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of one version (the newest by default)."""
    bare = VersionedTables(spark, path, {}, 0)
    found = bare.version(version)
    layout = {name: tuple(about) for name, about in found.notes["layout"].items()}
    store = VersionedTables(spark, path, layout, found.notes["buckets"])
    tables = {name: store.read(found, name) for name in layout}
    _agree(tables)
    return tables


def _agree(tables: dict[str, DataFrame]) -> None:
    """Tags, labels and vectors must be about the same points, and edges start at them."""
    if "vectors" not in tables:
        return
    ids = tables["vectors"].select("id")
    for name in ("tags", "labels"):
        if name in tables and tables[name].count() != ids.count():
            raise ValueError(f"{name} and vectors have different counts")
    if "edges" in tables:
        ends = tables["edges"].select(F.col("src").alias("id")).distinct()
        if not ends.join(ids, "id", "left_anti").isEmpty():
            raise ValueError("edges start at unknown points")
