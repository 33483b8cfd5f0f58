"""Last op per tag as keyed state in the RocksDB state store, with time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUE = "tags binary"
OUT = "tag long, ts timestamp, op_id long, op string, expired boolean"
BUCKETS = 1024
KEY = ["untagged", "tag"]


class LastOp(StatefulProcessor):
    """Keeps (ts, op_id, op) of the last op of each tag of a bucket, by (ts, op_id); emits a tag's row whenever that changes.

    A bucket's tags lie in one value and are merged with a micro-batch's ops as columns: a call, a read and a write per
    bucket and not per tag. A tag whose last op is a delete is forgotten ``keep_deleted`` milliseconds of event time after
    it (its row goes out once more, marked expired): by then the watermark has passed every op that could still come
    before it. A bucket's timer is set to the first of these times. Without a bound nothing is forgotten.
    """

    def __init__(self, keep_deleted: int | None):
        self.keep_deleted = keep_deleted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tags = handle.getValueState("tags", VALUE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = None
        for frame in rows:  # a hot tag comes in many frames; one row of it is kept
            mine = frame[[*KEY, "ts", "op_id", "op"]]
            found = _last(mine if found is None else pd.concat([mine, found]))
        if found is None:
            return
        known = self._known()
        merged = _last(pd.concat([found.assign(new=True), known.assign(new=False)] if known is not None else [found.assign(new=True)]))
        changed = merged["new"].to_numpy(bool)
        if changed.any():
            self._keep(merged.drop(columns="new"))
            yield _rows(merged[changed], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        if known is None:
            return
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        gone = (known["op"] == "delete").to_numpy() & (self._due(known) <= passed)
        self._keep(known[~gone])
        if gone.any():
            yield _rows(known[gone], True)

    def _known(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(bytes(self.tags.get()[0])).read_pandas() if self.tags.exists() else None

    def _due(self, known: pd.DataFrame) -> np.ndarray:
        return known["ts"].to_numpy("datetime64[ms]").astype(np.int64) + self.keep_deleted

    def _keep(self, known: pd.DataFrame) -> None:
        if len(known):
            table, sink = pa.Table.from_pandas(known, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.tags.update((sink.getvalue().to_pybytes(),))
        else:
            self.tags.clear()
        if self.keep_deleted is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            deleted = known[known["op"] == "delete"]
            if len(deleted):
                self.handle.registerTimer(int(self._due(deleted).min()))

    def close(self) -> None:
        pass


def _last(rows: pd.DataFrame) -> pd.DataFrame:
    """The last row of each tag by (ts, op_id); of equal ones the one that stands last."""
    return rows.sort_values(["ts", "op_id"], kind="stable").drop_duplicates(KEY, keep="last")


def _rows(rows: pd.DataFrame, expired: bool) -> pd.DataFrame:
    return pd.DataFrame({
        "tag": rows["tag"].astype("Int64").mask(rows["untagged"].astype(bool)).to_numpy(object, na_value=None) if rows["untagged"].any() else rows["tag"].to_numpy(),
        "ts": rows["ts"].to_numpy(), "op_id": rows["op_id"].astype("int64").to_numpy(), "op": rows["op"].to_numpy(object), "expired": expired})


def last_writer_state(
    stream: DataFrame, path: str, checkpoint: str, *, watermark: str | None = None, keep_deleted_ms: int | None = None,
) -> StreamingQuery:
    """Last op per tag of a stream ``(ts, op_id, op, tag)``; changes go to ``path/batch_id=N``.

    State is one value per bucket of tags, a fixed number of them, and lies in RocksDB, outside the heap; a checkpoint with
    a value per tag cannot be gone on with. Any cut of the stream into micro-batches, any order inside them and a restart from the checkpoint give one answer. ``keep_deleted_ms`` needs a ``watermark``: ops later
    than it are dropped, and a deleted tag leaves the state that long after its delete.
    """
    if (keep_deleted_ms is None) != (watermark is None):
        raise ValueError("keep_deleted_ms and watermark go together: a forgotten delete must not meet an older insert")
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # A null tag is a tag; pandas would turn the others beside it into floats.
    rows = stream.select(
        "ts", "op_id", "op", F.coalesce(F.col("tag").cast("long"), F.lit(0).cast("long")).alias("tag"), F.col("tag").isNull().alias("untagged"),
        F.pmod(F.xxhash64("tag"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    if watermark is not None:
        rows = rows.withWatermark("ts", watermark)
    last = rows.groupBy("bucket").transformWithStateInPandas(
        LastOp(keep_deleted_ms), OUT, "Update", "None" if watermark is None else "EventTime")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        last.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return query


def read_last_state(spark: SparkSession, path: str) -> DataFrame:
    """``(tag, ts, op_id, op)``: the newest row of each tag that has not expired."""
    rows = spark.read.schema(f"{OUT}, batch_id long").parquet(path)
    newest = rows.groupBy("tag").agg(F.max(F.struct("batch_id", "expired", "ts", "op_id", "op")).alias("n"))
    return newest.where("NOT n.expired").select("tag", "n.ts", "n.op_id", "n.op")
