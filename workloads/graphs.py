"""Graph jobs. Edges both engines can compute are the exact 8 nearest neighbours of every vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators import evaluate, graph, incremental
from vecloom.operators.knn import exact_knn
from vecloom.operators.prune import robust_prune
from vecloom.operators.search import graph_search
from vecloom.operators.shards import medoid, shard_points, shard_vectors
from vecloom.plans.scratch import stored

from . import inputs as i
from .registry import query

PAIRS = "p AS (SELECT a.id AS src, b.id AS dst, list_distance(a.vec, b.vec) ** 2 AS dist FROM v a JOIN v b ON a.id <> b.id)"
RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM p)"
EDGES = f"WITH RECURSIVE {i.SQL_VECTORS}, {PAIRS}, {RANKED}, e AS (SELECT src, dst, dist FROM rk WHERE r <= 8)"
MEDOID = (f"{i.SQL_ELEMENTS}, mu AS (SELECT list(x ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS x FROM el GROUP BY pos)), "
          "med AS (SELECT id FROM v, mu ORDER BY list_distance(vec, mean), id LIMIT 1)")


def neighbours(spark, sf, k=8, metric="l2"):
    found = exact_knn(i.vectors(spark, sf), i.all_queries(spark, sf), k, metric, skip_same=True)
    return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")


def _edges_out(edges):
    return edges.select("src", "dst", i.r6("dist").alias("dist"))


# With R = 2 pruning has a closed form: the nearest candidate c, then the first candidate not hidden
# by c in the lowest round of alpha.
POOL = "pool AS (SELECT src, dst, dist, r FROM rk WHERE r <= 20), c AS (SELECT src, dst AS kept FROM pool WHERE r = 1)"
TWO = ("two AS (SELECT src, dst, dist FROM pool WHERE r = 1 UNION ALL SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY level, dist, dst) AS n "
       "FROM ranked WHERE level <= 2) WHERE n = 1)")


@query("prune_two", f"WITH {i.SQL_VECTORS}, {PAIRS}, {RANKED}, {POOL}, ranked AS (SELECT pool.src, pool.dst, pool.dist, CASE WHEN pool.dist <= q.dist THEN 1 WHEN pool.dist <= 1.2 * q.dist THEN 2 ELSE 3 END AS level "
       f"FROM pool JOIN c USING (src) JOIN p q ON q.src = c.kept AND q.dst = pool.dst WHERE r > 1), {TWO} SELECT src, dst, round(dist, 6) AS dist FROM two")
def prune_two(spark, sf):
    return _edges_out(robust_prune(neighbours(spark, sf, 20), i.vectors(spark, sf), 2))


@query("prune_two_mips", f"WITH {i.SQL_VECTORS}, p AS (SELECT a.id AS src, b.id AS dst, -list_inner_product(a.vec, b.vec) AS dist FROM v a JOIN v b ON a.id <> b.id), {RANKED}, {POOL}, "
       "ranked AS (SELECT pool.src, pool.dst, pool.dist, CASE WHEN -q.dist > -pool.dist THEN 2 ELSE 1 END AS level FROM pool JOIN c USING (src) JOIN p q ON q.src = c.kept AND q.dst = pool.dst WHERE r > 1), "
       f"{TWO} SELECT src, dst, round(dist, 6) AS dist FROM two")
def prune_two_mips(spark, sf):
    return _edges_out(robust_prune(neighbours(spark, sf, 20, "mips"), i.vectors(spark, sf), 2, metric="mips"))


@query("prune_two_guarded", f"WITH {i.SQL_VECTORS}, {i.SQL_LABELLED}, {PAIRS}, {RANKED}, {POOL}, ranked AS (SELECT pool.src, pool.dst, pool.dist, "
       "CASE WHEN pool.dist <= q.dist OR NOT list_has_all(k.labels, j.labels) THEN 1 WHEN pool.dist <= 1.2 * q.dist THEN 2 ELSE 3 END AS level "
       f"FROM pool JOIN c USING (src) JOIN p q ON q.src = c.kept AND q.dst = pool.dst JOIN pl k ON k.id = c.kept JOIN pl j ON j.id = pool.dst WHERE r > 1), {TWO} SELECT src, dst, round(dist, 6) AS dist FROM two")
def prune_two_guarded(spark, sf):
    return _edges_out(robust_prune(neighbours(spark, sf, 20), i.labelled(spark, sf), 2, guard=True))


@query("prune_invariants", f"{EDGES} SELECT id AS src, dst AS nearest_kept, true AS within_degree FROM v JOIN rk ON src = id WHERE r = 1")
def prune_invariants(spark, sf):
    kept = robust_prune(neighbours(spark, sf, 40), i.vectors(spark, sf), 12)
    return kept.groupBy("src").agg(
        F.min(F.struct("dist", "dst")).alias("m"), F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("u")
    ).select("src", F.col("m.dst").alias("nearest_kept"), ((F.col("n") <= 12) & (F.col("n") == F.col("u"))).alias("within_degree"))


@query("prune_saturated", "SELECT vec_id AS src, 30::BIGINT AS degree FROM embeddings")
def prune_saturated(spark, sf):
    kept = robust_prune(neighbours(spark, sf, 40), i.vectors(spark, sf), 30, saturate=True)
    return kept.groupBy("src").agg(F.count_distinct("dst").alias("degree"))


@query("add_reverse", f"{EDGES} SELECT src, dst, round(min(dist), 6) AS dist FROM (SELECT src, dst, dist FROM e UNION ALL SELECT dst, src, dist FROM e) GROUP BY src, dst")
def add_reverse(spark, sf):
    return _edges_out(graph.add_reverse(neighbours(spark, sf)))


@query("cap_degree", f"{EDGES}, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)) "
       "SELECT src, CASE WHEN count(*) <= 13 THEN count(*) ELSE -1 END AS kept_degree, true AS within_bound FROM b GROUP BY src")
def cap_degree(spark, sf):
    """Points up to 1.3 * 10 keep all edges; the others are pruned to 10."""
    both = stored(graph.add_reverse(neighbours(spark, sf)), "both")
    capped = graph.cap_degree(both, i.vectors(spark, sf), 10, 1.3)
    before = both.groupBy("src").agg(F.count(F.lit(1)).alias("b"))
    after = capped.groupBy("src").agg(F.count(F.lit(1)).alias("a"))
    return before.join(after, "src").select(
        "src", F.when(F.col("b") <= 13, F.col("a")).otherwise(F.lit(-1)).alias("kept_degree"),
        (F.col("a") <= F.when(F.col("b") <= 13, 13).otherwise(10)).alias("within_bound"))


SHARD_EDGES = (f"WITH {i.SQL_VECTORS}, {i.SQL_CENTERS}, a AS (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY list_distance(v.vec, c.vec) ** 2, cid) AS r FROM v, c), "
               "m AS (SELECT cid, id, vec FROM a JOIN v USING (id) WHERE r <= 2), "
               "g AS (SELECT cid, x.id AS src, y.id AS dst, list_distance(x.vec, y.vec) ** 2 AS dist FROM m x JOIN m y USING (cid) WHERE x.id <> y.id), "
               "t AS (SELECT cid, src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY cid, src ORDER BY dist, dst) AS r FROM g) WHERE r <= 6)")


def _shard_members(spark, sf):
    base = i.vectors(spark, sf)
    return shard_vectors(base, shard_points(base, i.class_centers(spark, sf), 2))


@query("shard_candidates", f"{SHARD_EDGES} SELECT cid AS shard, src, dst, round(dist, 6) AS dist FROM t")
def shard_candidates(spark, sf):
    return graph.group_candidates(_shard_members(spark, sf), 6).withColumn("dist", i.r6("dist"))


@query("merge_graphs", f"{SHARD_EDGES} SELECT src, dst, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('6|' || src || '|' || dst), dst) AS n "
       "FROM (SELECT src, dst, min(dist) AS dist FROM t GROUP BY src, dst)) WHERE n <= 8")
def merge_graphs(spark, sf):
    return _edges_out(graph.merge_graphs(graph.group_candidates(_shard_members(spark, sf), 6), 8, seed=6))


def _sound(spark, sf, edges, R, reach=True):
    """One row: the graph has no faults, and how it hangs together."""
    points = i.vectors(spark, sf)
    edges = stored(edges.select("src", "dst", "dist"), "built")
    faults = graph.check_graph(points, edges, R)
    stats = graph.degree_stats(points, edges)
    n_reached = graph.bfs_distances(edges, medoid(points).select("id")).agg(F.count(F.lit(1)).alias("reached"))
    return faults.crossJoin(stats).crossJoin(n_reached).select(
        "n", (F.col("self_loops") + F.col("repeated") + F.col("dangling") + F.col("over_degree")).alias("faults"),
        (F.col("max_degree") <= R).alias("within_degree"), (F.col("reached") >= 0.95 * F.col("n")).alias("connected"))


SOUND = "SELECT count(*) AS n, 0::BIGINT AS faults, true AS within_degree, true AS connected FROM embeddings"


@query("build_graph", SOUND)
def build_graph(spark, sf):
    return _sound(spark, sf, graph.build_graph(i.vectors(spark, sf), R=24, L=60), 24)


GROWN = "SELECT count(*) AS n, 0::BIGINT AS faults, true AS within_degree, true AS connected, true AS few_pairs, true AS recall_reached FROM embeddings"


@query("build_graph_doubling", GROWN)
def build_graph_doubling(spark, sf):
    """Pairs of an eighth of the points, then three doublings by walks; every vector asks the graph for its neighbours."""
    base, asked = i.vectors(spark, sf), i.all_queries(spark, sf)
    n = base.count()
    edges, entry = incremental.grow_graph(base, R=16, L=24, seed_rows=n // 8)
    edges = stored(edges, "grown")
    walk = graph_search(edges, base, asked, entry, 10, 48, W=48)
    recall = evaluate.recall(walk.results(10, skip_same=True), exact_knn(base, asked, 10, skip_same=True), 10)
    placing = graph_search(edges, base, asked, entry, 1, 24, W=8)
    mean = placing.stats.agg(F.avg("n_cmps").alias("n_cmps"))  # what placing one more point costs
    return _sound(spark, sf, edges, 16).crossJoin(recall).crossJoin(mean).select(  # one row each
        "n", "faults", "within_degree", "connected", (F.col("n_cmps") <= 0.75 * n).alias("few_pairs"), (F.col("recall") >= 90).alias("recall_reached"))


@query("build_graph_over_shards", SOUND)
def build_graph_over_shards(spark, sf):
    base = i.vectors(spark, sf)
    shard_map = shard_points(base, i.class_centers(spark, sf), 2)
    return _sound(spark, sf, graph.build_graph(base, R=24, L=60, shard_map=shard_map), 24)


@query("build_graph_refined", SOUND)
def build_graph_refined(spark, sf):
    return _sound(spark, sf, graph.build_graph(i.vectors(spark, sf), R=16, L=32, refine=1), 16)


@query("build_filtered_graph", SOUND)
def build_filtered_graph(spark, sf):
    return _sound(spark, sf, graph.build_graph(i.labelled(spark, sf), R=24, L=40, labels=True), 24)


@query("build_sharded_graph", SOUND)
def build_sharded_graph(spark, sf):
    base = i.vectors(spark, sf)
    shard_map = shard_points(base, i.class_centers(spark, sf), 2)
    return _sound(spark, sf, graph.build_sharded(base, R=24, L=60, shard_map=shard_map), 24)


@query("build_stitched_graph", SOUND)
def build_stitched_graph(spark, sf):
    return _sound(spark, sf, graph.build_stitched(i.labelled(spark, sf), R=12, L=40, R_stitched=24), 24)


@query("graph_candidates", "SELECT vec_id AS src, true AS enough, true AS exact_dist FROM embeddings")
def graph_candidates(spark, sf):
    from vecloom.functions.distances import l2sq
    base = i.vectors(spark, sf)
    edges = stored(graph.add_reverse(neighbours(spark, sf, 12)), "edges")
    met = graph.graph_candidates(base, edges, medoid(base).select("id"), 24)
    a = base.select(F.col("id").alias("src"), F.col("vec").alias("a"))
    b = base.select(F.col("id").alias("dst"), F.col("vec").alias("b"))
    return met.join(a, "src").join(b, "dst").groupBy("src").agg(
        (F.count(F.lit(1)) >= 20).alias("enough"), (F.max(F.abs(l2sq("a", "b") - F.col("dist"))) < 1e-9).alias("exact_dist"))


@query("degree_stats", f"{EDGES}, d AS (SELECT id, count(src) AS deg FROM v LEFT JOIN (SELECT dst, src FROM e) ON dst = id GROUP BY id) "
       "SELECT count(*) AS n, max(deg) AS max_degree, round(avg(deg), 6) AS avg_degree, min(deg) AS min_degree, count(*) FILTER (deg < 2) AS below_two FROM d")
def degree_stats(spark, sf):
    """In-degrees: the edges turned around, so they differ from point to point."""
    turned = neighbours(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return graph.degree_stats(i.vectors(spark, sf), turned).withColumn("avg_degree", i.r6("avg_degree"))


BFS = f"{EDGES}, {MEDOID}, w(id, level) AS (SELECT id, 0 FROM med UNION SELECT e.dst, level + 1 FROM w JOIN e ON e.src = w.id WHERE level < 12), lv AS (SELECT id, min(level)::BIGINT AS level FROM w GROUP BY id) "


@query("bfs_levels", BFS + "SELECT level, count(*) AS n FROM lv GROUP BY level")
def bfs_levels(spark, sf):
    entry = medoid(i.vectors(spark, sf)).select("id")
    found = graph.bfs_levels(stored(neighbours(spark, sf), "edges"), entry, 12)
    return found.select(F.col("level").cast("long").alias("level"), "n")


@query("bfs_nodes", BFS + "SELECT id, level FROM lv ORDER BY level, id LIMIT (SELECT floor(count(*) * 0.1)::BIGINT FROM v)")
def bfs_nodes(spark, sf):
    base = i.vectors(spark, sf)
    found = graph.bfs_nodes(base, stored(neighbours(spark, sf), "edges"), medoid(base).select("id"), 10_000_000)
    return found.select("id", F.col("level").cast("long").alias("level"))


@query("hot_nodes", f"{EDGES} SELECT dst AS id, count(*) AS visits FROM e GROUP BY dst ORDER BY visits DESC, id LIMIT 25")
def hot_nodes(spark, sf):
    """Visits of a trace in which every vector visits its 8 nearest."""
    return graph.hot_nodes(neighbours(spark, sf).select(F.col("src").alias("qid"), F.col("dst").alias("id")), 25)


@query("check_graph", f"{EDGES}, bad AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM v WHERE label = 0 UNION ALL SELECT src, dst FROM e JOIN v ON id = src WHERE label = 1 "
       "UNION ALL SELECT id, id + 1000000 FROM v WHERE label = 2) SELECT (SELECT count(*) FROM bad WHERE src = dst) AS self_loops, "
       "(SELECT count(*) FROM (SELECT src FROM bad GROUP BY src, dst HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM bad WHERE dst >= 1000000) AS dangling, "
       "(SELECT count(*) FROM (SELECT src FROM bad GROUP BY src HAVING count(*) > 8)) AS over_degree")
def check_graph(spark, sf):
    points = i.vectors(spark, sf)
    marked = i.table(spark, sf, "embeddings").select(F.col("vec_id").alias("src"), "label")
    good = stored(neighbours(spark, sf).select("src", "dst"), "edges")
    bad = (
        good.unionByName(marked.where("label = 0").select("src", F.col("src").alias("dst")))
        .unionByName(good.join(marked.where("label = 1"), "src").select("src", "dst"))
        .unionByName(marked.where("label = 2").select("src", (F.col("src") + 1_000_000).alias("dst")))
    )
    return graph.check_graph(points, bad, 8)


@query("entry_points", f"WITH {i.SQL_VECTORS}, {MEDOID} SELECT 'medoid' AS kind, id FROM med UNION ALL SELECT 'sphere', -n FROM (SELECT unnest(range(1, 4)) AS n)")
def entry_points(spark, sf):
    base = i.vectors(spark, sf)
    both = graph.entry_points(base).select("kind", "id").unionByName(graph.entry_points(base, 3, "sphere", 4).select("kind", "id"))
    return both
