"""Inserts, deletes, repair, and the op streams made from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators import evaluate, graph, live, shards
from vecloom.operators.knn import exact_knn
from vecloom.operators.search import graph_search
from vecloom.plans.numbering import number_rows
from vecloom.plans.scratch import new_path, stored
from vecloom.streaming import oplog
from vecloom.streaming.last_writer import last_writer_state, read_last_state

from . import inputs as i
from .graphs import EDGES, neighbours
from .registry import query

OPS = ("o AS (SELECT event_id AS op_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, CASE event_type WHEN 'signup' THEN 'insert' ELSE 'delete' END AS op, "
       "event_id % (SELECT count(*) FROM embeddings) AS tag FROM events WHERE event_type IN ('signup', 'error'))")
# Tag 0 is refused on insert, so it is never live.
CHAIN = OPS + (", ch AS (SELECT *, lag(op) OVER (PARTITION BY tag ORDER BY seq) AS prev FROM o WHERE NOT (tag = 0 AND op = 'insert')), "
               "st AS (SELECT seq, op, tag, CASE WHEN op = 'insert' THEN CASE WHEN prev = 'insert' THEN 'exists' ELSE 'ok' END "
               "ELSE CASE WHEN prev = 'insert' THEN 'ok' ELSE 'missing' END END AS status FROM ch UNION ALL SELECT seq, op, tag, 'reserved' FROM o WHERE tag = 0 AND op = 'insert')")
LIVE = "lv AS (SELECT tag, max(seq) AS seq FROM ch WHERE op = 'insert' GROUP BY tag HAVING max(seq) >= (SELECT coalesce(max(c2.seq), -1) FROM ch c2 WHERE c2.tag = ch.tag AND c2.op = 'delete'))"


def ops(spark, sf):
    """``(op_id, ts, seq, op, tag, vec, labels)``: signups insert, errors delete."""
    n = i.vectors(spark, sf).count()
    events = i.table(spark, sf, "events").where(F.col("event_type").isin("signup", "error")).select(
        F.col("event_id").alias("op_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", "insert").otherwise("delete").alias("op"), (F.col("event_id") % n).alias("tag"))
    base = i.labelled(spark, sf).select(F.col("id").alias("tag"), "vec", "labels")
    return stored(number_rows(events, ["ts", "op_id"], "seq").join(base, "tag"), "ops")


def _no_live(spark):
    return spark.createDataFrame([], "tag long, vec array<float>")


@query("resolve_ops", f"WITH {CHAIN} SELECT seq, op, tag, status FROM st")
def resolve_ops(spark, sf):
    done = live.resolve_ops(_no_live(spark), ops(spark, sf), chunk=F.floor(F.col("seq") / 700))
    return done.select("seq", "op", "tag", "status")


BATCH = f"WITH {OPS}, lv0 AS (SELECT vec_id AS tag FROM embeddings WHERE label < 5)"


def _initial(spark, sf):
    return i.table(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("tag"), F.col("embedding").alias("vec"))


@query("apply_inserts", f"{BATCH}, b AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) AS n FROM o WHERE op = 'insert') SELECT seq, tag, CASE WHEN tag = 0 THEN 'reserved' "
       "WHEN tag IN (SELECT tag FROM lv0) OR n > 1 THEN 'exists' ELSE 'ok' END AS status FROM b")
def apply_inserts(spark, sf):
    batch = ops(spark, sf).where("op = 'insert'").select("seq", "tag", "vec")
    return live.apply_inserts(_initial(spark, sf), batch)[1]


@query("apply_inserts_live_set", f"{BATCH} SELECT tag FROM lv0 UNION SELECT tag FROM o WHERE op = 'insert' AND tag <> 0")
def apply_inserts_live_set(spark, sf):
    batch = ops(spark, sf).where("op = 'insert'").select("seq", "tag", "vec")
    return live.apply_inserts(_initial(spark, sf), batch)[0].select("tag")


@query("insert_capacity", f"{BATCH}, b AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) AS n FROM o WHERE op = 'insert'), "
       "s AS (SELECT CASE WHEN tag = 0 THEN 'reserved' WHEN tag IN (SELECT tag FROM lv0) OR n > 1 THEN 'exists' ELSE 'full' END AS status FROM b) SELECT status, count(*) AS n, true AS consolidate FROM s GROUP BY status")
def insert_capacity(spark, sf):
    """One slot too few refuses the batch as a whole."""
    start = _initial(spark, sf)
    batch = stored(ops(spark, sf).where("op = 'insert'").select("seq", "tag", "vec"), "batch")
    fits = batch.where("tag <> 0").select("tag").distinct().join(start.select("tag"), "tag", "left_anti").count() + start.count()
    _, status, consolidate = live.apply_inserts(start, batch, max_points=fits - 1)
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("consolidate", F.lit(consolidate))


@query("insert_needs_labels", f"{BATCH} SELECT seq, CASE WHEN tag = 0 THEN 'reserved' WHEN tag % 3 <> 0 THEN 'no_labels' WHEN n > 1 THEN 'exists' ELSE 'ok' END AS status "
       "FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) AS n FROM o WHERE op = 'insert')")
def insert_needs_labels(spark, sf):
    only = F.filter("labels", lambda x: x == "by_3")
    batch = ops(spark, sf).where("op = 'insert'").select("seq", "tag", "vec", only.alias("labels"))
    empty = spark.createDataFrame([], "tag long, vec array<float>, labels array<string>")
    return live.apply_inserts(empty, batch, filtered=True)[1].select("seq", "status")


@query("apply_deletes", f"{BATCH}, b AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) AS n FROM o WHERE op = 'delete') SELECT seq, tag, CASE WHEN tag IN (SELECT tag FROM lv0) AND n = 1 THEN 'ok' ELSE 'missing' END AS status FROM b")
def apply_deletes(spark, sf):
    return live.apply_deletes(_initial(spark, sf), ops(spark, sf).where("op = 'delete'").select("seq", "tag"))[2]


@query("deletes_hide_at_once", f"{BATCH} SELECT tag, tag IN (SELECT tag FROM o WHERE op = 'delete') AS tombstone FROM lv0")
def deletes_hide_at_once(spark, sf):
    left, gone, _ = live.apply_deletes(_initial(spark, sf), ops(spark, sf).where("op = 'delete'").select("seq", "tag"))
    return left.select("tag", F.lit(False).alias("tombstone")).unionByName(gone.select("tag", F.lit(True).alias("tombstone")))


@query("active_tags", f"{BATCH} SELECT vec_id AS tag FROM embeddings WHERE vec_id NOT IN (SELECT tag FROM o WHERE op = 'delete')")
def active_tags(spark, sf):
    points = i.vectors(spark, sf).select(F.col("id").alias("tag"))
    return live.active_tags(points, ops(spark, sf).where("op = 'delete'"))


@query("live_status", f"{BATCH}, d AS (SELECT DISTINCT tag FROM o WHERE op = 'delete') SELECT count(*) AS held, (SELECT count(*) FROM d) AS deleted, count(*) - (SELECT count(*) FROM d) AS live, 10000 - count(*) AS free FROM embeddings")
def live_status(spark, sf):
    points = i.vectors(spark, sf).select(F.col("id").alias("tag"))
    return live.status(points, ops(spark, sf).where("op = 'delete'"), 10000)


DEAD = "d AS (SELECT id FROM v WHERE label = 3)"


def _dead(spark, sf):
    return i.table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))


@query("repair", f"{EDGES.replace(', e AS (', ', e AS MATERIALIZED (')}, d AS MATERIALIZED (SELECT id FROM v WHERE label = 3), "
       "x AS MATERIALIZED (SELECT e.*, s.id IS NOT NULL AS from_dead, t.id IS NOT NULL AS to_dead FROM e LEFT JOIN d s ON e.src = s.id LEFT JOIN d t ON e.dst = t.id), "
       "k AS MATERIALIZED (SELECT src, dst FROM x WHERE NOT from_dead AND NOT to_dead UNION SELECT a.src, b.dst FROM x a JOIN x b ON a.dst = b.src "
       "WHERE NOT a.from_dead AND a.to_dead AND NOT b.to_dead AND a.src <> b.dst) "
       "SELECT src, dst, round(list_distance(a.vec, b.vec) ** 2, 6) AS dist FROM k JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def repair(spark, sf):
    return live.repair(stored(neighbours(spark, sf), "edges"), _dead(spark, sf), i.vectors(spark, sf)).withColumn("dist", i.r6("dist"))


@query("consolidate", f"{EDGES}, {DEAD}, t AS (SELECT DISTINCT src FROM e WHERE src NOT IN (FROM d) AND dst IN (FROM d)) "
       "SELECT (SELECT count(*) FROM d) AS deleted_points, (SELECT count(*) FROM t) AS repaired_points, true AS within_degree, 0::BIGINT AS touching_deleted, true AS untouched_kept")
def consolidate(spark, sf):
    edges, dead = stored(neighbours(spark, sf), "edges"), _dead(spark, sf)
    after, report = live.consolidate(edges, dead, i.vectors(spark, sf), 8)
    degree = after.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg((F.max("d") <= 8).alias("within_degree"))
    touching = after.select(F.explode(F.array("src", "dst")).alias("id")).join(dead, "id", "left_semi").agg(F.count(F.lit(1)).alias("touching_deleted"))
    touched = edges.join(dead.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src").distinct()
    still = edges.join(touched, "src", "left_anti").join(dead.withColumnRenamed("id", "src"), "src", "left_anti")
    kept = still.select("src", "dst").exceptAll(after.select("src", "dst")).agg((F.count(F.lit(1)) == 0).alias("untouched_kept"))
    return report.crossJoin(degree).crossJoin(touching).crossJoin(kept).select(
        "deleted_points", "repaired_points", "within_degree", "touching_deleted", "untouched_kept")


@query("compact", f"{EDGES}, {DEAD}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM v WHERE id NOT IN (FROM d)) SELECT a.new AS src, b.new AS dst, "
       "(SELECT count(*) FROM e WHERE src IN (FROM d) OR dst IN (FROM d)) AS dangling FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst")
def compact(spark, sf):
    left = i.vectors(spark, sf).join(_dead(spark, sf), "id", "left_anti")
    _, edges, dangling = live.compact(left, neighbours(spark, sf))
    return edges.select("src", "dst").crossJoin(dangling)


@query("graph_insert", "SELECT count(*) AS n, 0::BIGINT AS faults, true AS finds_inserted FROM embeddings")
def graph_insert(spark, sf):
    """The upper half of the classes joins a graph over the lower half."""
    e = i.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    old, new = stored(e.where("label < 5").select("id", "vec"), "old"), stored(e.where("label >= 5").select("id", "vec"), "new")
    entry = stored(shards.medoid(old).select("id"), "entry")
    edges = live.graph_insert(graph.build_graph(old, R=20, L=40), old, new, entry, R=20, L=40)
    everyone = i.vectors(spark, sf)
    faults = graph.check_graph(everyone, edges, 20)
    queries = i.all_queries(spark, sf)
    found = graph_search(edges, everyone, queries, entry, 10, 40, W=40).results(10, skip_same=True)
    recall = evaluate.recall(found, exact_knn(everyone, queries, 10, skip_same=True), 10)
    return faults.crossJoin(recall).select(
        F.col("n_queries").alias("n"), (F.col("self_loops") + F.col("repeated") + F.col("dangling") + F.col("over_degree")).alias("faults"),
        (F.col("recall") >= 90).alias("finds_inserted"))


@query("new_label_starts", "WITH dl AS (SELECT doc_id AS id, unnest([lang, source]) AS label FROM documents), f AS (SELECT label, min(id) AS id FROM dl WHERE label NOT IN (SELECT lang FROM documents) GROUP BY label), "
       "r AS (SELECT *, row_number() OVER (ORDER BY label) AS n FROM f) SELECT label, CASE WHEN n <= 2 THEN id END AS id FROM r")
def new_label_starts(spark, sf):
    """Languages have starts already; two slots are free for the sources."""
    docs = i.document_labels(spark, sf)
    known = docs.select(F.col("labels")[0].alias("label"), "id").groupBy("label").agg(F.min("id").alias("id"))
    fresh, failed = live.new_label_starts(known, docs, 2)
    return fresh.select("label", "id").unionByName(failed.select("label", F.lit(None).cast("long").alias("id")))


@query("clustered_ingest", f"WITH {i.SQL_VECTORS}, {i.SQL_CENTERS}, a AS (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY list_distance(v.vec, c.vec) ** 2, cid) AS r FROM v, c), "
       "l AS (SELECT row_number() OVER (ORDER BY cid, id) - 1 AS pos, id FROM a WHERE r = 1) SELECT pos // 64 AS batch, pos, id FROM l")
def clustered_ingest(spark, sf):
    return live.clustered_ingest(i.vectors(spark, sf), i.class_centers(spark, sf), 64).select("batch", "pos", "id")


def _op_files(spark, sf, parts=4):
    """The ops in ``parts`` files, written one after the other in op order."""
    rows, path = ops(spark, sf), new_path(spark, "op-files")
    n = rows.count()
    for p in range(parts):
        rows.where(F.floor(F.col("seq") * parts / n) == p).coalesce(1).write.mode("append").parquet(path)
    return rows.schema, path


def _replayed(spark, sf, parts=4, snapshot_every=None):
    schema, files = _op_files(spark, sf, parts)
    return oplog.replay(spark, files, schema, new_path(spark, "oplog"), new_path(spark, "stream"),
                        snapshot_every=snapshot_every)


FINAL = f"WITH {CHAIN}, fin AS (SELECT tag, arg_max(op, seq) AS op FROM ch GROUP BY tag)"


@query("stream_live_set", f"{FINAL} SELECT tag, round(list_sum(embedding::DOUBLE[]), 6) AS vec_sum FROM fin JOIN embeddings ON vec_id = tag WHERE op = 'insert'")
def stream_live_set(spark, sf):
    """Four micro-batches; versions before the last one are removed after every second."""
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _replayed(spark, sf, 4, snapshot_every=2).live().select("tag", i.r6(total).alias("vec_sum"))


@query("stream_live_set_other_cut", f"{FINAL} SELECT tag FROM fin WHERE op = 'insert'")
def stream_live_set_other_cut(spark, sf):
    return _replayed(spark, sf, 2).live_tags().select("tag")


@query("stream_statuses", f"WITH {CHAIN} SELECT status, op, count(*) AS n FROM st GROUP BY status, op")
def stream_statuses(spark, sf):
    return _replayed(spark, sf, 3).statuses().groupBy("status", "op").agg(F.count(F.lit(1)).alias("n"))


@query("window_live_set", "SELECT event_id + 1 AS tag FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 500")
def window_live_set(spark, sf):
    """The newest 500 of all signups stay live."""
    rows = i.table(spark, sf, "events").where("event_type = 'signup'").select(
        "ts", (F.col("event_id") + 1).alias("tag"), F.array(F.col("value").cast("float")).alias("vec"), F.array("event_type").alias("labels"))
    rows, path = stored(number_rows(rows, ["ts", "tag"], "seq"), "signups"), new_path(spark, "signup-files")
    n = rows.count()
    for p in range(3):
        rows.where(F.floor(F.col("seq") * 3 / n) == p).drop("seq").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.drop("seq").schema).option("maxFilesPerTrigger", 1).parquet(path)
    where = new_path(spark, "window")
    oplog.active_window(stream, where, new_path(spark, "stream"), 500, consolidate_every=600).awaitTermination()
    return oplog.OpLog(spark, where).live_tags().select("tag")


@query("last_writer", f"WITH {OPS} SELECT tag, arg_max(op_id, seq) AS op_id, arg_max(op, seq) AS op FROM o GROUP BY tag")
def last_writer(spark, sf):
    schema, files = _op_files(spark, sf, 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    where = new_path(spark, "last-writer")
    oplog.last_writer(stream, where, new_path(spark, "stream")).awaitTermination()
    return oplog.read_last_writer(spark, where).select("tag", "op_id", "op")


@query("last_writer_state", f"WITH {OPS} SELECT parts::BIGINT AS parts, tag, arg_max(op_id, seq) AS op_id, arg_max(op, seq) AS op FROM o, (SELECT unnest([1, 2, 3]) AS parts) GROUP BY parts, tag")
def last_writer_states(spark, sf):
    """The last op of each tag as keyed state, for three cuts of the stream."""
    out = None
    for parts in (1, 2, 3):
        schema, files = _op_files(spark, sf, parts)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
        where = new_path(spark, "last-state")
        last_writer_state(stream, where, new_path(spark, "stream")).awaitTermination()
        mine = read_last_state(spark, where).select(F.lit(parts).cast("long").alias("parts"), "tag", "op_id", "op")
        out = mine if out is None else out.unionByName(mine)
    return out
