"""Updates of a live point set and repair of its graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import DEFAULTS
from ..functions.distances import distance
from ..plans.lookup import hot_lookup
from ..plans.numbering import number_rows
from ..plans.scratch import stored
from .graph import cap_degree
from .incremental import as_edges, as_lists, insert_delta, replaced, rounds_of
from .labels import point_labels
from .shards import cluster_order

RESERVED_TAG = 0
CHUNK = 65_536  # ops of one piece of history


def refusal(filtered: bool = False, labels: str = "labels") -> Column:
    """Why an insert is refused whatever the state: ``reserved`` tag, ``no_labels``, or NULL."""
    reason = F.when(F.col("tag") == RESERVED_TAG, "reserved")
    if filtered:
        reason = reason.when(F.col(labels).isNull() | (F.size(labels) == 0), "no_labels")
    return reason


def resolve_ops(live: DataFrame, ops: DataFrame, filtered: bool = False, chunk: Column | None = None) -> DataFrame:
    """Adds ``status`` to ``ops(seq, op, tag, ...)``: ok, exists, missing, reserved or no_labels.

    ``op`` is insert or delete, ``seq`` the order. After any valid insert a tag is live and after
    any delete it is not, so the state before an op follows from the op before it. A tag with very
    many ops is cut into ``chunk`` pieces of its history: each piece starts from the last op of the
    piece before, and windows run inside pieces only.
    """
    chunk = F.floor(F.col("seq") / CHUNK) if chunk is None else chunk
    ops = ops.withColumn("_refused", F.when(F.col("op") == "insert", refusal(filtered))).withColumn("_chunk", chunk)
    valid = ops.where(F.col("_refused").isNull())
    lasts = valid.groupBy("tag", "_chunk").agg(F.max_by("op", "seq").alias("_last"))
    pieces = Window.partitionBy("tag").orderBy("_chunk")
    before = (
        lasts.withColumn("_carried", F.lag("_last").over(pieces))
        .join(live.select("tag", F.lit("insert").alias("_initial")), "tag", "left")
        .select("tag", "_chunk", F.coalesce("_carried", "_initial").alias("_carried"))
    )
    inside = Window.partitionBy("tag", "_chunk").orderBy("seq")
    chained = (
        valid.join(before, ["tag", "_chunk"])
        .withColumn("_live", F.coalesce(F.lag("op").over(inside), F.col("_carried")) == "insert")
    )
    status = (
        F.when(F.col("op") == "insert", F.when(F.coalesce("_live", F.lit(False)), "exists").otherwise("ok"))
        .otherwise(F.when(F.coalesce("_live", F.lit(False)), "ok").otherwise("missing"))
    )
    refused = ops.where(F.col("_refused").isNotNull()).withColumn("status", F.col("_refused"))
    return (
        chained.withColumn("status", status).drop("_live", "_carried", "_refused", "_chunk")
        .unionByName(refused.drop("_refused", "_chunk"))
    )


def apply_inserts(
    live: DataFrame, batch: DataFrame, filtered: bool = False, max_points: int | None = None, deleted: int = 0,
) -> tuple[DataFrame, DataFrame, bool]:
    """Insert ``batch(seq, tag, vec[, labels])`` into ``live(tag, vec[, labels])``.

    Returns the new live set, ``(seq, tag, status)`` and whether the ``deleted`` points still
    holding room must be consolidated first. A batch that does not fit ``max_points`` even then is
    refused as a whole (status ``full``). The first row of a tag wins inside a batch.
    """
    resolved = stored(resolve_ops(live, batch.withColumn("op", F.lit("insert")), filtered), "inserts")
    consolidate = False
    if max_points is not None:
        n_live, n_new = live.count(), resolved.where("status = 'ok'").count()
        consolidate = n_live + deleted + n_new > max_points
        if n_live + n_new > max_points:
            resolved = resolved.withColumn("status", F.when(F.col("status") == "ok", "full").otherwise(F.col("status")))
    accepted = resolved.where("status = 'ok'").select(*live.columns)
    return live.unionByName(accepted), resolved.select("seq", "tag", "status"), consolidate


def apply_deletes(live: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete ``batch(seq, tag)``: the new live set, the tombstones, ``(seq, tag, status)``."""
    resolved = stored(resolve_ops(live, batch.withColumn("op", F.lit("delete"))), "deletes")
    gone = resolved.where("status = 'ok'").select("tag")
    return (
        live.join(gone, "tag", "left_anti"), live.join(gone, "tag", "left_semi"),
        resolved.select("seq", "tag", "status"))


def active_tags(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    return points.select("tag").join(tombstones.select("tag"), "tag", "left_anti")


def status(points: DataFrame, tombstones: DataFrame, max_points: int) -> DataFrame:
    """One row: points held, deleted among them, live, free slots."""
    held = points.agg(F.count(F.lit(1)).alias("held"))
    dead = points.join(tombstones.select("tag").distinct(), "tag", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return held.crossJoin(dead).select(  # one row each
        "held", "deleted", (F.col("held") - F.col("deleted")).alias("live"), (F.lit(max_points) - F.col("held")).alias("free"))


def repair(edges: DataFrame, deleted: DataFrame, vectors: DataFrame, metric: str = "l2") -> DataFrame:
    """Edges of live points after the deleted ``(id)`` are bridged over, before any pruning.

    A point that pointed at deleted ones gets their live neighbours instead, never itself.
    """
    dead = deleted.select("id").distinct()
    links = edges.select("src", "dst", "dist")
    alive_from = links.join(dead, links.src == dead.id, "left_anti")
    kept = alive_from.join(dead, alive_from.dst == dead.id, "left_anti")
    into = alive_from.join(dead, alive_from.dst == dead.id, "left_semi").select("src", F.col("dst").alias("via"))
    out_of = links.join(dead, links.src == dead.id, "left_semi").select(F.col("src").alias("via"), "dst")
    out_of = out_of.join(dead, out_of.dst == dead.id, "left_anti")
    into = stored(into, "into")
    uses = into.groupBy("via").agg(F.count(F.lit(1)).alias("_uses"))
    around = out_of.groupBy("via").agg(F.collect_list("dst").alias("_next")).join(uses, "via")  # at most R neighbours each
    bridged = hot_lookup(into, stored(around, "around"), "via", "_uses").select("src", F.explode("_next").alias("dst"))
    bridged = bridged.where("src <> dst").distinct()
    fresh = bridged.join(kept.select("src", "dst"), ["src", "dst"], "left_anti")
    a = vectors.select(F.col("id").alias("src"), F.col("vec").alias("_a"))
    b = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("_b"))
    scored = fresh.join(a, "src").join(b, "dst").select("src", "dst", distance(metric, "_a", "_b").alias("dist"))
    return kept.unionByName(scored)


def consolidate(
    edges: DataFrame, deleted: DataFrame, vectors: DataFrame, R: int, alpha: float = DEFAULTS["alpha"], metric: str = "l2",
) -> tuple[DataFrame, DataFrame]:
    """Repaired edges with at most R per point, and one report row."""
    edges = stored(edges.select("src", "dst", "dist"), "before")
    repaired = stored(repair(edges, deleted, vectors, metric), "repaired")
    capped = stored(cap_degree(repaired, vectors, R, alpha=alpha, metric=metric), "consolidated")
    dead = deleted.select("id").distinct()
    touched = (
        edges.join(dead, edges.dst == dead.id, "left_semi").select("src").distinct()
        .join(dead, F.col("src") == dead.id, "left_anti").agg(F.count(F.lit(1)).alias("repaired_points"))
    )
    pruned = repaired.groupBy("src").agg(F.count(F.lit(1)).alias("_d")).agg(
        F.count_if(F.col("_d") > R).alias("pruned_points"))
    report = (
        dead.agg(F.count(F.lit(1)).alias("deleted_points")).crossJoin(touched).crossJoin(pruned)  # one row each
        .crossJoin(capped.agg(F.count(F.lit(1)).alias("edges")))
    )
    return capped, report


def compact(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense ids from 0 in id order: points, rewritten edges, and ``(dangling)`` edges dropped."""
    numbered = stored(number_rows(points, ["id"], "new_id"), "numbered")
    src = numbered.select(F.col("id").alias("src"), F.col("new_id").alias("_src"))
    dst = numbered.select(F.col("id").alias("dst"), F.col("new_id").alias("_dst"))
    joined = stored(edges.join(src, "src", "left").join(dst, "dst", "left"), "renumbered")
    whole = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    rewritten = joined.where(whole).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "dist")
    return (
        numbered.withColumn("old_id", F.col("id")).withColumn("id", F.col("new_id")).drop("new_id"),
        rewritten, joined.agg(F.count_if(~whole).alias("dangling")))


def graph_insert(
    edges: DataFrame, vectors: DataFrame, batch: DataFrame, entries: DataFrame, R: int, L: int = DEFAULTS["build_list"],
    alpha: float = DEFAULTS["alpha"], metric: str = "l2", *, starts: DataFrame | None = None, universal: str | None = None,
) -> DataFrame:
    """Edges after the points ``batch(id, vec[, labels])`` join a graph over ``vectors``; no two of them are compared as such.

    They come in rounds no larger than the graph, each walked for twice. With ``starts(label, id)`` a point is walked for
    under its labels; a new label needs a start among the points, see :func:`new_label_starts`.
    """
    lists = stored(as_lists(edges.select("src", "dst", "dist")), "lists")
    columns = ["id", "vec", *(["labels"] if starts is not None else [])]
    held = vectors.select(*columns)
    for rows in rounds_of(batch.select(*columns), held.count()):
        delta = insert_delta(lists, held, rows, entries, R, L, alpha, metric, starts=starts, universal=universal)
        lists = stored(replaced(lists, delta), "lists")
        held = stored(held.unionByName(rows), "held")
    return as_edges(lists)


def new_label_starts(starts: DataFrame, batch: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """``(label, id)`` starts for labels first seen in ``batch(id, labels)``, and labels left without.

    The first point with a new label is its start; labels beyond the free ``slots`` (in label
    order) are returned as failed.
    """
    fresh = (
        point_labels(batch).join(starts.select("label").distinct(), "label", "left_anti")
        .groupBy("label").agg(F.min("id").alias("id"))
    )
    ranked = number_rows(fresh, ["label"], "_n")
    return ranked.where(F.col("_n") < slots).select("label", "id"), ranked.where(F.col("_n") >= slots).select("label")


def clustered_ingest(df: DataFrame, centers: DataFrame, batch_rows: int) -> DataFrame:
    """``(batch, pos, cid, id)``: insert batches that follow the clusters."""
    return cluster_order(df, centers).withColumn("batch", F.floor(F.col("pos") / batch_rows).cast("long"))
