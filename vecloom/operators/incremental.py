"""Changes of a graph as deltas: the whole new lists of the points whose lists change, and of no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import DEFAULTS
from ..functions.distances import distance
from ..plans.blocks import cell_pairs
from ..plans.lookup import hot_lookup
from ..plans.numbering import number_rows
from ..plans.scratch import small_or_same, stored
from .graph import bfs_distances, cap_degree, group_candidates
from .knn import rank_results
from .labels import point_labels
from .prune import robust_prune
from .search import graph_search
from .shards import medoid

SEED_ROWS = 16_384  # rows that begin a graph by meeting each other; after that it grows by at most its own size at a time

GIVEN = 4          # times that places are given to points which no list takes by itself


def as_lists(edges: DataFrame) -> DataFrame:
    """``(src, nbrs ARRAY<STRUCT<dist, dst>>)`` by distance; the degree bound keeps the arrays small."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("nbrs"))


def as_edges(lists: DataFrame) -> DataFrame:
    return lists.select("src", F.explode("nbrs").alias("e")).select("src", "e.dst", "e.dist")


def empty_lists(points: DataFrame) -> DataFrame:
    return points.sparkSession.createDataFrame([], "src long, nbrs array<struct<dist:double,dst:bigint>>")


def _asked(batch: DataFrame, starts: DataFrame | None, universal: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Queries of new points: ``(qid, qvec, src)``, and with labels ``(qid, qvec, src, label)``, one per started label.

    A point with the ``universal`` label belongs everywhere and asks without a label.
    """
    plain = batch.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("id").alias("src"))
    if starts is None:
        return plain, None
    everywhere = F.array_contains("labels", universal) if universal is not None else F.lit(False)
    pairs = point_labels(batch.where(~everywhere)).select("id", "label").distinct().join(starts.select("label"), "label", "left_semi")
    numbered = stored(number_rows(pairs, ["id", "label"], "qid"), "asked")
    by_label = numbered.join(batch.select("id", F.col("vec").alias("qvec")), "id").select(
        "qid", "qvec", F.col("id").alias("src"), "label")
    named = batch.select(F.col("id").alias("src"), everywhere.alias("_everywhere"))
    return plain.join(named.where("_everywhere").select("src"), "src", "left_semi"), by_label


def walked_candidates(
    lists: DataFrame, points: DataFrame, batch: DataFrame, entry: DataFrame, L: int, metric: str,
    starts: DataFrame | None = None, universal: str | None = None,
) -> DataFrame:
    """``(src, dst, dist)``: what a walk for each new point expands; with labels one walk per label, from its start.

    A pair that several walks of a point meet is there as often.
    """
    graph = lists.select("src", F.col("nbrs.dst").alias("nbrs"))
    plain, by_label = _asked(batch, starts, universal)
    walks = []
    if starts is None or not plain.isEmpty():
        walks.append((plain, graph_search(graph, points, plain.drop("src"), entry, 1, L, metric=metric)))
    if by_label is not None and not by_label.isEmpty():
        begin = starts.select("label", F.array("id").alias("starts"))
        asked = by_label.drop("src")
        walks.append((by_label, graph_search(
            graph, points, asked, entry, 1, L, metric=metric, starts=begin, universal=universal)))
    if not walks:
        return as_edges(empty_lists(points))
    out = None
    for asked, walk in walks:
        # a point that asks without a label has its own id as qid
        met = walk.trace.withColumnRenamed("qid", "src") if asked is plain else walk.trace.join(asked.select("qid", "src"), "qid")
        met = met.select("src", F.col("id").alias("dst"), "dist")
        out = met if out is None else out.unionByName(met)
    return out.where("src <> dst")


def insert_delta(
    lists: DataFrame, points: DataFrame, batch: DataFrame, entry: DataFrame | None, R: int, L: int = DEFAULTS["build_list"],
    alpha: float = DEFAULTS["alpha"], metric: str = "l2", *, starts: DataFrame | None = None, universal: str | None = None,
    seeds: DataFrame | None = None, again: bool = True, everywhere: bool = False, **prune,
) -> DataFrame:
    """Delta ``(src, nbrs)`` for new points ``batch(id, vec[, labels])`` of a graph ``lists(src, nbrs)`` over ``points``.

    The graph is walked for each new point, what the walk expands is pruned to at most R edges, these get
    their reverse, and lists beyond R are pruned. ``again`` walks once more over the graph so far, so that the new points
    meet each other without being compared pair by pair. With ``starts(label, id)`` a point is walked for under
    each of its labels, entering points with that label only, and pruning keeps label paths. ``seeds(src, dst, dist)``
    are more candidates; an empty graph, without an ``entry``, begins from them alone. ``everywhere`` also walks without
    labels. Further options go to the pruning.
    """
    prune = {"alpha": alpha, "metric": metric, "guard": starts is not None, **prune}
    everyone = points.unionByName(batch.select(*points.columns))
    new = batch.select(F.col("id").alias("src"))

    def joined(lists: DataFrame, candidates: DataFrame) -> DataFrame:
        out = stored(robust_prune(candidates, everyone, R, **prune), "out-edges")
        back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
        changed = back.select("src").distinct().join(new, "src", "left_anti")
        before = as_edges(lists.join(changed, "src", "left_semi"))
        edges = before.unionByName(out).unionByName(back).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        return stored(as_lists(cap_degree(edges, everyone, R, **prune)), "delta")

    def walked(lists: DataFrame, points: DataFrame) -> DataFrame:
        met = walked_candidates(lists, points, batch, entry, L, metric, starts, universal)
        if starts is None or not everywhere:
            return met
        return met.unionByName(walked_candidates(lists, points, batch, entry, L, metric))

    found = None if entry is None else walked(lists, points)
    if seeds is not None:
        found = seeds if found is None else found.unionByName(seeds)
    delta = joined(lists, found)
    if not again or entry is None:
        return delta
    so_far = replaced(lists, delta)
    met = walked(so_far, everyone)
    mine = as_edges(delta.join(new, "src", "left_semi"))
    return stored(replaced(delta, joined(so_far, met.unionByName(mine))), "delta")


def replaced(lists: DataFrame, delta: DataFrame) -> DataFrame:
    """``lists`` with those of ``delta`` in their place."""
    return lists.join(delta.select("src"), "src", "left_anti").unionByName(delta)


def seed_pairs(points: DataFrame, L: int, metric: str) -> DataFrame:
    """``(src, dst, dist)``: the L nearest of at most SEED_ROWS points to each of them."""
    asked = points.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    pairs = rank_results(cell_pairs(points.select("id", "vec"), asked, metric, k=L, skip_same=True), L)
    return pairs.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")


def label_seeds(batch: DataFrame, labels: DataFrame, L: int, metric: str, seed_rows: int = SEED_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first ``seed_rows`` points ``(id)`` under each of the new ``labels(label)``, and the pairs among these."""
    by_id = Window.partitionBy("label").orderBy("id")
    first = point_labels(batch).select("id", "label").distinct().join(labels.select("label"), "label", "left_semi").withColumn(
        "_n", F.row_number().over(by_id)).where(F.col("_n") <= seed_rows).drop("_n")
    members = stored(first.join(batch.select("id", "vec"), "id"), "seeds")
    return members.select("id").distinct(), group_candidates(members, L, metric, "label").select("src", "dst", "dist")


def rounds_of(points: DataFrame, held: int, first: DataFrame | None = None, seed_rows: int = SEED_ROWS) -> list[DataFrame]:
    """New points in rounds, none larger than the graph before it: doubling, in order of a seeded hash.

    The points ``first(id)`` make the first rounds.
    """
    early = F.lit(1) if first is None else F.when(F.col("_early"), 0).otherwise(1)
    rows = points
    if first is not None:
        rows = points.join(first.select("id", F.lit(True).alias("_early")), "id", "left").withColumn(
            "_early", F.coalesce("_early", F.lit(False)))
    placed = stored(number_rows(rows.withColumn("_turn", early).withColumn("_h", F.xxhash64(F.lit(11), "id")), ["_turn", "_h", "id"], "_at"), "placed")
    n, at, out = placed.count(), 0, []
    while at < n:
        size = max(held + at, seed_rows)
        out.append(placed.where((F.col("_at") >= at) & (F.col("_at") < at + size)).select(*points.columns))
        at += size
    return out


def grow_graph(
    points: DataFrame, R: int = DEFAULTS["degree"], L: int = DEFAULTS["build_list"], alpha: float = DEFAULTS["alpha"],
    metric: str = "l2", *, labels: bool = False, seed_rows: int = SEED_ROWS, again: bool = True, **prune,
) -> tuple[DataFrame, DataFrame]:
    """Edges over ``points(id, vec[, labels])`` built by doubling, and the entry ``(id)`` the walks began from.

    The first ``seed_rows`` points are compared pair by pair, with ``labels`` also the first ``seed_rows`` under each
    label; after that the graph over n points is walked to place the next n. So the pairs scored per point are those
    of its walks, however many points there are in all or under one label, and one rule holds at every size.
    """
    points = points.select("id", "vec", *(["labels"] if labels else []))
    first = starts = pairs = None
    if labels:
        starts = stored(point_labels(points).groupBy("label").agg(F.min("id").alias("id")), "starts")
        first, pairs = label_seeds(points, starts, L, metric, seed_rows)
        first, pairs = stored(first, "first"), stored(pairs, "pairs")
    rounds = rounds_of(points, 0, first, seed_rows)
    if not rounds:
        return as_edges(empty_lists(points)), points.select("id").limit(0)
    held, lists, entry = points.limit(0), empty_lists(points), None
    for batch in rounds:
        seeds = None if entry is not None else seed_pairs(batch, L, metric)
        if labels:
            mine = pairs.join(batch.select(F.col("id").alias("src")), "src", "left_semi")
            seeds = mine if seeds is None else seeds.unionByName(mine)
        delta = insert_delta(
            lists, held, batch, entry, R, L, alpha, metric, starts=starts, seeds=seeds, again=again, everywhere=True, **prune)
        if entry is None:
            held, lists, entry = batch, delta, stored(medoid(batch).select("id"), "entry")
        else:
            held, lists = stored(held.unionByName(batch), "held"), stored(replaced(lists, delta), "lists")
    return as_edges(lists), entry


def removal_delta(
    lists: DataFrame, points: DataFrame, gone: DataFrame, R: int, alpha: float = DEFAULTS["alpha"], metric: str = "l2",
    guard: bool = False,
) -> DataFrame:
    """Delta ``(src, nbrs)`` of the live points that pointed at points ``gone(id)``; ``points`` still holds these.

    Such a point gets the live neighbours of the gone ones it knew, and is pruned to R. A gone point that very many
    pointed at is looked up by broadcast, so its rows stay spread. A list left empty is in the delta as an empty list.
    """
    dead = stored(gone.select(F.col("id").alias("_dead")).distinct(), "dead")
    known = small_or_same(dead)
    edges = as_edges(lists).join(known, F.col("src") == F.col("_dead"), "left_anti")
    broken = stored(
        edges.join(known, F.col("dst") == F.col("_dead"), "left_semi").select("src", F.col("dst").alias("via")), "broken")
    around = as_edges(lists.join(known, F.col("src") == F.col("_dead"), "left_semi")).join(
        known, F.col("dst") == F.col("_dead"), "left_anti").groupBy("src").agg(F.collect_list("dst").alias("_next"))
    uses = broken.groupBy("via").agg(F.count(F.lit(1)).alias("_uses"))
    bridges = stored(around.withColumnRenamed("src", "via").join(uses, "via"), "bridges")
    bridged = hot_lookup(broken, bridges, "via", "_uses").select("src", F.explode("_next").alias("dst"))
    touched = stored(broken.select("src").distinct(), "touched")
    kept = edges.join(touched, "src", "left_semi").join(known, F.col("dst") == F.col("_dead"), "left_anti")
    fresh = bridged.where("src <> dst").distinct().join(kept.select("src", "dst"), ["src", "dst"], "left_anti")
    a = points.select(F.col("id").alias("src"), F.col("vec").alias("_a"))
    b = points.select(F.col("id").alias("dst"), F.col("vec").alias("_b"))
    scored = fresh.join(a, "src").join(b, "dst").select("src", "dst", distance(metric, "_a", "_b").alias("dist"))
    whole = stored(cap_degree(kept.unionByName(scored), points, R, alpha=alpha, metric=metric, guard=guard), "whole")
    none = F.array().cast("array<struct<dist:double,dst:bigint>>")
    left = touched.join(whole.select("src").distinct(), "src", "left_anti").select("src", none.alias("nbrs"))
    return as_lists(whole).unionByName(left)


def handed_over(starts: DataFrame, points: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(label, id)`` new starts of labels whose start is gone, and ``(label)`` of those that no point carries any more.

    The live point with the smallest id takes over.
    """
    lost = stored(starts.join(gone.select("id").distinct(), "id", "left_semi").select("label"), "lost")
    live = points.join(gone.select("id").distinct(), "id", "left_anti")
    heirs = stored(
        point_labels(live).select("id", "label").join(small_or_same(lost), "label", "left_semi")
        .groupBy("label").agg(F.min("id").alias("id")), "heirs")
    return heirs, lost.join(heirs, "label", "left_anti")


def unreached(lists: DataFrame, points: DataFrame, entry: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``(id, label)`` of the points that no path from the ``entry`` leads to; the label is null.

    With ``starts(label, id)`` a point must be reached from the start of each of its labels, over points with that
    label, and is returned once for each label under which it is not.
    """
    edges = as_edges(lists).select("src", "dst")
    if starts is None:
        lost = points.select("id").join(bfs_distances(edges, entry), "id", "left_anti")
        return lost.withColumn("label", F.lit(None).cast("string"))
    labels = stored(point_labels(points).select("id", "label").distinct().join(starts.select("label"), "label", "left_semi"), "labels")
    pair = F.struct("label", "id")
    by_src = labels.select(F.col("id").alias("src"), "label", pair.alias("_src"))
    by_dst = labels.select(F.col("id").alias("dst"), "label", pair.alias("_dst"))
    paths = stored(edges.join(by_src, "src").join(by_dst, ["dst", "label"]).select(
        F.col("_src").alias("src"), F.col("_dst").alias("dst")), "paths")
    reached = bfs_distances(paths, starts.select(pair.alias("id")))
    return labels.select(pair.alias("id")).join(reached, "id", "left_anti").select("id.id", "id.label")


def reconnected(
    lists: DataFrame, points: DataFrame, entry: DataFrame, R: int, L: int, alpha: float = DEFAULTS["alpha"], metric: str = "l2",
    *, starts: DataFrame | None = None, universal: str | None = None,
) -> DataFrame | None:
    """Delta ``(src, nbrs)`` after which points cut off by removals are reached again, or None if none is.

    The points that were not reached join once more like new ones, with the neighbours they have, for as long as
    this leaves fewer of them. One that no list would take is then given the place of a neighbour that many others know.
    """
    delta, before, given = None, None, 0
    while True:
        now = lists if delta is None else replaced(lists, delta)
        lost = stored(unreached(now, points, entry, starts), "lost")
        n = lost.count()
        if n == 0:
            return delta
        ids = lost.select("id").distinct()
        batch = stored(points.join(ids, "id", "left_semi"), "batch")
        mine = as_edges(now.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
        if before is None or n < before:
            more = insert_delta(
                now, points.join(ids, "id", "left_anti"), batch, entry, R, L, alpha, metric, starts=starts,
                universal=universal, seeds=mine, again=False)
        elif given < GIVEN:
            given += 1
            met = walked_candidates(now, points, batch, entry, L, metric, starts, universal)
            near = mine.unionByName(met).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
            more = stored(_taken_in(now, points, lost, near, R), "taken-in")
        else:
            return delta
        delta, before = more if delta is None else stored(replaced(delta, more), "delta"), n


def _taken_in(lists: DataFrame, points: DataFrame, lost: DataFrame, near: DataFrame, R: int) -> DataFrame:
    """New lists of the nearest of the ``near(src, dst, dist)`` points of ``lost(id, label)`` that are not lost under the label.

    Where a list is full, those of its neighbours go that most other lists hold; half of it stays.
    """
    wanted = near.join(lost.withColumnRenamed("id", "src"), "src")
    if "labels" in points.columns:
        wanted = wanted.join(points.select(F.col("id").alias("dst"), "labels"), "dst").where(
            F.col("label").isNull() | F.array_contains(F.col("labels"), F.col("label"))).drop("labels")
    others = lost.select(F.col("id").alias("_lost"), F.col("label").alias("_label"))
    hosts = wanted.join(others, (F.col("dst") == F.col("_lost")) & F.col("label").eqNullSafe(F.col("_label")), "left_anti")
    chosen = hosts.groupBy("src", "label").agg(F.min(F.struct("dist", "dst")).alias("e")).select(
        F.col("e.dst").alias("src"), F.col("src").alias("dst"), "e.dist").distinct()
    room = Window.partitionBy("src").orderBy("dist", "dst")
    fresh = stored(chosen.withColumn("_n", F.row_number().over(room)).where(F.col("_n") <= R // 2 + 1).drop("_n"), "fresh")
    edges = as_edges(lists)
    known = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_known"))
    old = edges.join(fresh.select("src").distinct(), "src", "left_semi").join(fresh.select("src", "dst"), ["src", "dst"], "left_anti")
    old = old.join(known, "dst").select("src", "dst", "dist", "_known")
    both = fresh.withColumn("_known", F.lit(0).cast("long")).unionByName(old)
    least = Window.partitionBy("src").orderBy("_known", "dist", "dst")
    return as_lists(both.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= R))
