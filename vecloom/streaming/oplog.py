"""Insert / delete streams that keep the live points in tag buckets.

A micro-batch reads and rewrites the buckets of the tags it names and publishes them as one version under its own
number, so its cost follows its own size and not the history. A repeated batch finds its version published. A deleted tag
leaves its bucket; old generations of buckets go with the versions that name them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.live import resolve_ops
from ..plans.numbering import number_rows
from ..plans.scratch import stored
from ..sources.buckets import Version, VersionedTables, folders

LAYOUT = {"live": ("tag", "tag long, batch_id long, seq long, vec array<float>, labels array<string>")}
STATUS = "tag long, op string, seq long, status string, batch_id long"
BUCKETS = 16


@dataclass
class OpLog:
    """Folder with the versions of the live points and ``status/batch_id=N`` of every op.

    ``buckets`` is fixed when the folder is created; choose it so that a bucket is the work of one task.
    """

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @property
    def tables(self) -> VersionedTables:
        return VersionedTables(self.spark, f"{self.path}/tables", LAYOUT, self.buckets)

    def create(self) -> OpLog:
        self.tables.create({"next_seq": 0})
        return self

    def version(self, before: int = 1 << 62) -> Version:
        """The newest version older than batch ``before``."""
        return self.tables.version(max(n for n in self.tables.numbers() if n < before))

    def live(self, before: int = 1 << 62) -> DataFrame:
        """Live points ``(tag, seq, vec, labels)``."""
        return self.tables.read(self.version(before), "live").select("tag", "seq", "vec", "labels")

    def live_tags(self, before: int = 1 << 62) -> DataFrame:
        return self.tables.read(self.version(before), "live").select("tag", "batch_id", "seq")

    def statuses(self) -> DataFrame:
        if not folders(self.spark, f"{self.path}/status", "batch_id"):
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).parquet(f"{self.path}/status")

    def append(self, batch_id: int, ops: DataFrame, filtered: bool = False, next_seq: int | None = None) -> None:
        """Apply the valid ops of one micro-batch; once its version is published, again does nothing."""
        tables = self.tables
        if batch_id in tables.numbers():
            return
        before = self.version(batch_id)
        now = Version(batch_id, before.gens, before.next_gen, dict(before.notes))
        if next_seq is not None:
            now.notes["next_seq"] = next_seq
        ops = stored(ops, "ops")
        live = stored(tables.matching(before, "live", ops).select("tag"), "live")
        resolved = stored(resolve_ops(live, ops, filtered), "resolved")
        resolved.select("tag", "op", "seq", "status").write.mode("overwrite").parquet(f"{self.path}/status/batch_id={batch_id}")
        net = resolved.where("status = 'ok'").groupBy("tag").agg(F.max_by(F.struct("op", "seq", "vec", "labels"), "seq").alias("n"))
        net = stored(net.select("tag", F.lit(batch_id).cast("long").alias("batch_id"), "n.*"), "net")
        now = tables.change(now, "live", net.where("op = 'insert'"), net.where("op = 'delete'"))
        tables.publish(now)

    def compact(self, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` versions and the bucket files only they name."""
        self.tables.vacuum(keep)


def run_ops(
    stream: DataFrame, path: str, checkpoint: str, *, filtered: bool = False, snapshot_every: int | None = None,
    watermark: str | None = None,
) -> StreamingQuery:
    """Apply a stream of ``(op_id, ts, seq, op, tag, vec, labels)`` until its input is used up.

    Every op counts, whenever it comes. Only a caller that names a ``watermark`` has ops delivered twice
    within it counted once, and those later than it dropped. Every ``snapshot_every`` batches the versions before
    the last one are removed.
    """
    spark = stream.sparkSession
    log = OpLog(spark, path).create()
    once = stream
    if watermark is not None:
        once = stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["op_id"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        log.append(batch_id, batch.select("tag", "op", "seq", "vec", "labels"), filtered)
        if snapshot_every and (batch_id + 1) % snapshot_every == 0:
            log.compact()

    return (
        once.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def active_window(
    stream: DataFrame, path: str, checkpoint: str, window: int, consolidate_every: int | None = None,
) -> StreamingQuery:
    """Keep the last ``window`` points of a stream ``(ts, tag, vec, labels)`` of new tags.

    Points are numbered in (ts, tag) order after those of the batches before; what falls out of
    the window is deleted in the same batch.
    """
    spark = stream.sparkSession
    log = OpLog(spark, path).create()

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id in log.tables.numbers():
            return
        start = log.version(batch_id).notes["next_seq"]
        rows = stored(number_rows(batch.select("ts", "tag", "vec", "labels"), ["ts", "tag"], "seq", start=start), "block")
        n = rows.count()
        inserts = rows.select("tag", F.lit("insert").alias("op"), "seq", "vec", "labels")
        old = log.live_tags(batch_id).select("tag", "seq").unionByName(rows.select("tag", "seq"))
        none = [F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("array<string>").alias("labels")]
        leave = old.where(F.col("seq") < start + n - window).select(
            "tag", F.lit("delete").alias("op"), (F.lit(start + n) + F.col("seq")).alias("seq"), *none)
        log.append(batch_id, inserts.unionByName(leave), next_seq=start + n)
        if consolidate_every and (start + n) // consolidate_every > start // consolidate_every:
            log.compact()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def last_writer(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Last op per tag by (ts, op_id), kept as streaming aggregation state; updates go to ``path``.

    Any cut of the stream into micro-batches, and any order inside them, gives one answer.
    """
    last = stream.groupBy("tag").agg(F.max(F.struct("ts", "op_id", "op")).alias("last")).select("tag", "last.*")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        last.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_last_writer(spark: SparkSession, path: str) -> DataFrame:
    """Newest update per tag of :func:`last_writer`."""
    newest = F.max(F.struct("batch_id", "ts", "op_id", "op")).alias("_newest")
    return spark.read.parquet(path).groupBy("tag").agg(newest).select("tag", "_newest.ts", "_newest.op_id", "_newest.op")


def replay(
    spark: SparkSession, files: str, schema, path: str, checkpoint: str, *, files_per_batch: int = 1,
    snapshot_every: int | None = None, filtered: bool = False,
) -> OpLog:
    """Run a folder of op files through :func:`run_ops`, so many files per micro-batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(files)
    query = run_ops(stream, path, checkpoint, filtered=filtered, snapshot_every=snapshot_every)
    query.awaitTermination()
    return OpLog(spark, path)
