"""Proximity graphs as edge tables ``(src, dst, dist)``: building, merging, checking, walking levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import DEFAULTS
from ..functions.distances import l2sq
from ..functions.hashing import seeded_order
from ..plans.blocks import cell_pairs
from ..plans.scratch import stored
from ..plans.sums import vector_means
from .labels import expand_universal, point_labels
from .prune import robust_prune
from .shards import assign_centers, medoid, shard_bytes, shard_points, split_to_budget

SHARD_ROWS = 200_000  # rows that a shard of a sharded build may hold when the caller gives no sharding


def group_candidates(members: DataFrame, L: int, metric: str = "l2", group: str = "shard") -> DataFrame:
    """``(group, src, dst, dist)``: the L nearest rows of each row inside each of its groups.

    ``members(group, id, vec)``. Groups larger than a cell are scored cell by cell.
    """
    asked = members.select(group, F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    pairs = cell_pairs(members.select(group, "id", "vec"), asked, metric, k=L, by=group, skip_same=True, keep_group=True)
    best = Window.partitionBy(group, "qid").orderBy("dist", "id")
    return (
        pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= L)
        .select(group, F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")
    )


def add_reverse(edges: DataFrame, group: str | None = None) -> DataFrame:
    """Edges together with their reverse, each once."""
    by = [group] if group else []
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return (
        edges.select(*by, "src", "dst", "dist").unionByName(back)
        .groupBy(*by, "src", "dst").agg(F.min("dist").alias("dist"))
    )


def cap_degree(
    edges: DataFrame, vectors: DataFrame, R: int, slack: float = 1.0, group: str | None = None, **prune,
) -> DataFrame:
    """Prune the points with more than ``slack * R`` edges; the others keep theirs."""
    by = [group, "src"] if group else ["src"]
    edges = stored(edges, "edges")
    full = (
        edges.groupBy(*by).agg(F.count(F.lit(1)).alias("_deg"))
        .where(F.col("_deg") > int(slack * R)).select(*by)
    )
    kept = edges.join(full, by, "left_anti").select(*by, "dst", "dist")
    return kept.unionByName(robust_prune(edges.join(full, by, "left_semi"), vectors, R, group=group, **prune))


def link(candidates: DataFrame, vectors: DataFrame, R: int, group: str | None = None, **prune) -> DataFrame:
    """Candidates -> pruned edges -> reverse edges -> at most R edges per point."""
    forward = stored(robust_prune(candidates, vectors, R, group=group, **prune), "forward")
    return cap_degree(add_reverse(forward, group), vectors, R, 1.0, group, **prune)


def _members(points: DataFrame, shard_map: DataFrame) -> DataFrame:
    return stored(shard_map.select("shard", "id").join(points.select("id", "vec"), "id"), "members")


def _bridges(members: DataFrame, metric: str, near: int = 16) -> DataFrame:
    """Candidates between the middle points of nearby shards, so no shard is an island.

    Very many middles are joined in cells, so they get their bridges like few.
    """
    means = vector_means(members, "shard").select("shard", F.col("vec").alias("_mean"))
    middles = (
        members.join(means, "shard").groupBy("shard")
        .agg(F.min(F.struct(l2sq("vec", "_mean").alias("d"), "id", "vec")).alias("m"))
        .select(F.col("m.id").alias("cid"), F.col("m.vec").alias("vec")).dropDuplicates(["cid"])
    )
    middles = stored(middles, "middles")
    found = assign_centers(middles.withColumnRenamed("cid", "src"), middles, near + 1, metric, "src")
    return found.select("src", F.col("cid").alias("dst"), "dist").where("src <> dst")


def build_graph(
    points: DataFrame, R: int = DEFAULTS["degree"], L: int = DEFAULTS["build_list"], alpha: float = DEFAULTS["alpha"],
    metric: str = "l2", *, shard_map: DataFrame | None = None, labels: bool = False, universal: str | None = None,
    saturate: bool = False,
    maxc: int = DEFAULTS["max_candidates"], refine: int = 0, seed_rows: int | None = None,
) -> DataFrame:
    """Edges of a graph over ``points(id, vec[, labels])`` with at most R edges per point.

    Without a ``shard_map`` the graph grows by doubling: the first ``seed_rows`` points are compared pair by pair, the
    others placed by walks. With one, candidates are the L nearest rows in each overlapping shard, and the middle
    points of neighbouring shards. With ``labels`` candidates under each label join them, and pruning keeps
    label paths; points with the ``universal`` label count as carrying every label. ``refine`` rounds search the
    graph for every point and prune again over what the search met.
    """
    from .incremental import SEED_ROWS, grow_graph
    if labels and universal is not None:
        points = stored(expand_universal(points, universal), "points")
    prune = {"alpha": alpha, "maxc": maxc, "metric": metric, "saturate": saturate, "guard": labels}
    if shard_map is None:
        grown, _ = grow_graph(points, R, L, alpha, metric, labels=labels, seed_rows=seed_rows or SEED_ROWS, maxc=maxc, saturate=saturate)
        edges = stored(grown, "graph")
    else:
        members = _members(points, shard_map)
        candidates = group_candidates(members, L, metric).select("src", "dst", "dist").unionByName(_bridges(members, metric))
        if labels:
            tagged = point_labels(points).select("id", F.col("label")).distinct().join(points.select("id", "vec"), "id")
            candidates = candidates.unionByName(group_candidates(tagged, L, metric, "label").select("src", "dst", "dist"))
        edges = stored(link(candidates, points, R, **prune), "graph")
    for _ in range(refine):
        met = graph_candidates(points, edges, medoid(points).select("id"), L, metric)
        pool = met.unionByName(edges.select("src", "dst", "dist"))
        edges = stored(link(pool, points, R, **prune), "graph")
    return edges


def graph_candidates(points: DataFrame, edges: DataFrame, entries: DataFrame, L: int, metric: str = "l2", W: int = 16) -> DataFrame:
    """``(src, dst, dist)``: the points a search for each point expands."""
    from .search import graph_search
    asked = points.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    walk = graph_search(edges, points, asked, entries, 1, L, W=W, metric=metric)
    return walk.trace.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist").where("src <> dst")


def build_sharded(
    points: DataFrame, R: int, L: int = DEFAULTS["build_list"], alpha: float = DEFAULTS["alpha"], metric: str = "l2",
    *, shard_map: DataFrame | None = None, seed: int = 0,
) -> DataFrame:
    """One graph per overlapping shard with degree 2R/3, merged to at most R edges per point.

    Without a ``shard_map`` there are as many shards as it takes for none to hold more than about SHARD_ROWS points.
    """
    if shard_map is None:
        dim = len(points.select("vec").first()[0])
        centers, _, _ = split_to_budget(
            points, shard_bytes(SHARD_ROWS, dim, DEFAULTS["degree"]), DEFAULTS["degree"],
            rate=min(1.0, DEFAULTS["pq_train_rows"] / max(1, points.count())))
        shard_map = shard_points(points, centers)
    candidates = group_candidates(_members(points, shard_map), L, metric)
    edges = link(candidates, points, max(1, 2 * R // 3), "shard", alpha=alpha, metric=metric)
    return merge_graphs(edges, R, seed)


def build_stitched(
    points: DataFrame, R: int, L: int, R_stitched: int, alpha: float = DEFAULTS["alpha"], metric: str = "l2",
) -> DataFrame:
    """One graph per label over its points; their union pruned to ``R_stitched`` edges."""
    return cap_degree(label_graphs(points, R, L, alpha, metric), points, R_stitched, alpha=alpha, metric=metric)


def label_graphs(points: DataFrame, R: int, L: int, alpha: float = DEFAULTS["alpha"], metric: str = "l2") -> DataFrame:
    """Union of the graphs of all labels, each edge once."""
    members = stored(
        point_labels(points).select("id", "label").distinct().join(points.select("id", "vec"), "id"), "members")
    edges = link(group_candidates(members, L, metric, "label"), points, R, "label", alpha=alpha, metric=metric)
    return edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def merge_graphs(edges: DataFrame, R: int, seed: int = 0) -> DataFrame:
    """Union of shard graphs by global id; at most R edges per point, chosen in seeded order."""
    order = Window.partitionBy("src").orderBy("_h", "dst")
    return (
        edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        .withColumn("_h", seeded_order(seed, "src", "dst"))
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= R)
        .select("src", "dst", "dist")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """``(src, nbrs ARRAY<BIGINT>)``; the degree bound keeps the arrays small."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))


def degree_stats(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(n, max_degree, avg_degree, min_degree, below_two)`` over all points."""
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    return (
        points.select(F.col("id").alias("src")).join(degrees, "src", "left")
        .select(F.coalesce("deg", F.lit(0)).alias("deg"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.max("deg").alias("max_degree"), F.avg("deg").alias("avg_degree"),
            F.min("deg").alias("min_degree"), F.count_if(F.col("deg") < 2).alias("below_two"))
    )


def bfs_distances(edges: DataFrame, entries: DataFrame, max_levels: int | None = None) -> DataFrame:
    """``(id, level)`` of every point reached from the entries, or only of those within ``max_levels`` hops."""
    links = edges.select("src", "dst")
    level = stored(entries.select("id").distinct().withColumn("level", F.lit(0)), "bfs")
    reached, n = level, 0
    while max_levels is None or n < max_levels:
        n += 1
        ahead = level.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        level = stored(ahead.join(reached, "id", "left_anti").withColumn("level", F.lit(n)), "bfs")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
        if n % 32 == 0:
            reached = stored(reached, "bfs-reached")  # a long chain stays a short plan
    return reached


def bfs_levels(edges: DataFrame, entries: DataFrame, max_levels: int | None = None) -> DataFrame:
    """``(level, n)``: points per level."""
    return bfs_distances(edges, entries, max_levels).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def bfs_nodes(points: DataFrame, edges: DataFrame, entries: DataFrame, n: int, max_share: float = 0.1) -> DataFrame:
    """The n points nearest the entries in hops (ties by id), at most ``max_share`` of all points."""
    n = min(n, int(points.count() * max_share))
    return bfs_distances(edges, entries).orderBy("level", "id").limit(n)


def hot_nodes(trace: DataFrame, n: int) -> DataFrame:
    """``(id, visits)``: the n most visited points of a search trace."""
    return trace.groupBy("id").agg(F.count(F.lit(1)).alias("visits")).orderBy(F.desc("visits"), "id").limit(n)


def check_graph(points: DataFrame, edges: DataFrame, R: int) -> DataFrame:
    """One row: self loops, repeated edges, dangling ends, points over the degree bound."""
    ids = points.select("id")
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    repeated = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(
        F.count(F.lit(1)).alias("repeated"))
    dangling = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti").agg(
        F.count(F.lit(1)).alias("dangling"))
    over = edges.groupBy("src").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > R).agg(
        F.count(F.lit(1)).alias("over_degree"))
    return loops.crossJoin(repeated).crossJoin(dangling).crossJoin(over)  # one row each


def entry_points(points: DataFrame, n: int = 1, mode: str = "medoid", seed: int = 0) -> DataFrame:
    """Where searches start: the ``medoid`` of the points, or n random points on a ``sphere``."""
    from .shards import random_sphere_points
    if mode == "medoid":
        return medoid(points).select(F.lit("medoid").alias("kind"), "id").join(points.select("id", "vec"), "id")
    if mode == "sphere":
        return random_sphere_points(points, n, seed).withColumn("kind", F.lit("sphere")).select("id", "kind", "vec")
    raise ValueError(f"unknown mode {mode!r}")
