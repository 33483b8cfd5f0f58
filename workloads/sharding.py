"""Sampling, clustering, sharding and shard-pruned search."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vecloom.operators import evaluate, shards
from vecloom.operators.knn import exact_knn
from vecloom.plans.scratch import new_path, stored

from . import inputs as i
from .registry import query

BASE = f"WITH {i.SQL_VECTORS}, {i.SQL_CENTERS}"
NEAR = "a AS (SELECT id, cid, list_distance(v.vec, c.vec) ** 2 AS d, row_number() OVER (PARTITION BY id ORDER BY list_distance(v.vec, c.vec) ** 2, cid) AS r FROM v, c)"


@query("sample_vectors", "SELECT vec_id AS id FROM embeddings WHERE substr(md5('7|' || vec_id), 1, 8) < printf('%08x', (0.25 * 4294967296)::BIGINT)")
def sample_vectors(spark, sf):
    return shards.sample_vectors(i.vectors(spark, sf), 0.25, seed=7).select("id")


@query("assign_centers", f"{BASE}, {NEAR} SELECT id, cid, r AS rank, round(d, 6) AS dist FROM a WHERE r <= 3")
def assign_centers(spark, sf):
    found = shards.assign_centers(i.vectors(spark, sf), i.class_centers(spark, sf), 3)
    return found.select("id", "cid", F.col("rank").cast("long").alias("rank"), i.r6("dist").alias("dist"))


@query("inverted_lists", f"{BASE}, {NEAR} SELECT cid, row_number() OVER (PARTITION BY cid ORDER BY id) - 1 AS pos, id FROM a WHERE r <= 2")
def inverted_lists(spark, sf):
    return shards.inverted_lists(shards.assign_centers(i.vectors(spark, sf), i.class_centers(spark, sf), 2))


@query("lloyd_step", f"{BASE}, {NEAR}, j AS (SELECT cid, d, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM a JOIN v USING (id) WHERE r = 1) "
       "SELECT cid, pos - 1 AS pos, round(avg(x), 6) AS x, count(*) AS n, round(sum(d), 6) AS residual FROM j GROUP BY cid, pos")
def lloyd_step(spark, sf):
    step = shards.lloyd_step(i.vectors(spark, sf), i.class_centers(spark, sf))
    return step.select("cid", "n", i.r6("residual").alias("residual"), F.posexplode("vec").alias("pos", "x")).select(
        "cid", F.col("pos").cast("long").alias("pos"), i.r6("x").alias("x"), "n", "residual")


@query("lloyd_from_classes", "SELECT 10::BIGINT AS centers, count(*) AS members, true AS residual_falls FROM embeddings")
def lloyd_from_classes(spark, sf):
    base, start = i.vectors(spark, sf), i.class_centers(spark, sf)
    first = shards.lloyd_step(base, start).agg(F.sum("residual")).first()[0]
    centers, residual = shards.lloyd(base, start, 3)
    members = shards.lloyd_step(base, centers).agg(F.sum("n").alias("members"), F.sum("residual").alias("_after"))
    n = centers.agg(F.count(F.lit(1)).alias("centers"))
    return n.crossJoin(members).select("centers", "members", (F.col("_after") <= first).alias("residual_falls"))


@query("kmeans", "SELECT 8::BIGINT AS centers, count(*) AS members, true AS better_than_one_center FROM embeddings")
def kmeans(spark, sf):
    base = i.vectors(spark, sf)
    centers = shards.kmeans(base, 8, reps=5, seed=3)
    split = shards.lloyd_step(base, centers).agg(F.sum("n").alias("members"), F.sum("residual").alias("_r8"))
    one = i.vectors(spark, sf).select("vec", F.lit(0).cast("long").alias("cid"))
    mean = shards.vector_means(one, "cid").select("cid", "vec")
    whole = shards.lloyd_step(base, mean).agg(F.sum("residual").alias("_r1"))
    n = centers.agg(F.count(F.lit(1)).alias("centers"))
    return n.crossJoin(split).crossJoin(whole).select("centers", "members", (F.col("_r8") < F.col("_r1")).alias("better_than_one_center"))


@query("shard_map", f"{BASE}, {NEAR} SELECT id, cid AS shard, r AS rank FROM a WHERE r <= 2")
def shard_map(spark, sf):
    found = shards.shard_points(i.vectors(spark, sf), i.class_centers(spark, sf), 2)
    return found.select("id", "shard", F.col("rank").cast("long").alias("rank"))


@query("shard_vectors", f"{BASE}, {NEAR} SELECT cid AS shard, id, round(list_sum(vec), 6) AS vec_sum FROM a JOIN v USING (id) WHERE r <= 2")
def shard_vectors(spark, sf):
    base = i.vectors(spark, sf)
    rows = shards.shard_vectors(base, shards.shard_points(base, i.class_centers(spark, sf), 2))
    return rows.select("shard", "id", i.r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("vec_sum"))


@query("estimate_shards", f"{BASE}, {NEAR} SELECT cid AS shard, floor(count(*) / 0.5)::BIGINT AS estimate FROM a WHERE r <= 2 AND "
       "substr(md5('4|' || id), 1, 8) < printf('%08x', (0.5 * 4294967296)::BIGINT) GROUP BY cid")
def estimate_shards(spark, sf):
    sample = shards.sample_vectors(i.vectors(spark, sf), 0.5, seed=4)
    return shards.estimate_shards(sample, i.class_centers(spark, sf), 2, 0.5)


@query("partition_with_budget", "SELECT true AS fits, true AS odd_count, true AS covers_overlap FROM embeddings LIMIT 1")
def partition_with_budget(spark, sf):
    base = i.vectors(spark, sf)
    n = base.count()
    budget = shards.shard_bytes(int(n * 0.6), 64, 32)
    centers, estimate = shards.partition_with_budget(base, budget, 32, k_base=2, rate=0.5)
    parts = centers.count()
    return estimate.agg(F.max("estimate").alias("largest"), F.sum("estimate").alias("total")).select(
        (F.lit(1.1) * F.col("largest") * (64 * 4 + 32 * 4 * 1.3 + 8) <= budget).alias("fits"),
        F.lit(parts % 2 == 1).alias("odd_count"),
        F.col("total").between(int(1.5 * n), int(2.5 * n)).alias("covers_overlap"))


@query("cluster_order", f"{BASE}, {NEAR} SELECT row_number() OVER (ORDER BY cid, id) - 1 AS pos, cid, id FROM a WHERE r = 1")
def cluster_order(spark, sf):
    return shards.cluster_order(i.vectors(spark, sf), i.class_centers(spark, sf))


@query("cluster_offsets", f"{BASE}, {NEAR}, l AS (SELECT row_number() OVER (ORDER BY cid, id) - 1 AS pos, cid FROM a WHERE r = 1) SELECT cid, min(pos) AS first, count(*) AS n FROM l GROUP BY cid")
def cluster_offsets(spark, sf):
    return shards.cluster_offsets(shards.cluster_order(i.vectors(spark, sf), i.class_centers(spark, sf)))


@query("medoid", f"WITH {i.SQL_VECTORS}, {i.SQL_ELEMENTS}, m AS (SELECT list(x ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS x FROM el GROUP BY pos)) "
       "SELECT id, round(list_distance(vec, mean) ** 2, 6) AS dist FROM v, m ORDER BY list_distance(vec, mean), id LIMIT 1")
def medoid(spark, sf):
    return shards.medoid(i.vectors(spark, sf)).select("id", i.r6("dist").alias("dist"))


@query("sphere_entry_points", "SELECT -n AS id, 64::BIGINT AS dim, 1.0::DOUBLE AS norm FROM (SELECT unnest(range(1, 6)) AS n)")
def sphere_entry_points(spark, sf):
    points = shards.random_sphere_points(i.vectors(spark, sf), 5, seed=9)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return points.select("id", F.size("vec").cast("long").alias("dim"), F.round(norm, 4).alias("norm"))


@query("route_queries", f"{BASE}, {NEAR} SELECT id AS qid, cid AS shard, r AS rank, round(d, 6) AS dist FROM a WHERE r <= 2")
def route_queries(spark, sf):
    found = shards.route_queries(i.all_queries(spark, sf), i.class_centers(spark, sf), 2)
    return found.select("qid", "shard", F.col("rank").cast("long").alias("rank"), i.r6("dist").alias("dist"))


@query("ivf_top10", f"{BASE}, {NEAR}, p AS (SELECT DISTINCT q.id AS qid, b.id FROM a q JOIN a b ON q.cid = b.cid WHERE q.r <= 4 AND b.r <= 2 AND q.id <> b.id), "
       "s AS (SELECT qid, p.id, list_distance(q.vec, b.vec) ** 2 AS dist FROM p JOIN v q ON q.id = qid JOIN v b ON b.id = p.id) " + i.topk_sql("SELECT * FROM s", 10))
def ivf_top10(spark, sf):
    base, centers = i.vectors(spark, sf), i.class_centers(spark, sf)
    held = shards.shard_vectors(base, shards.shard_points(base, centers, 2))
    return i.shown(shards.ivf_search(held, centers, i.all_queries(spark, sf), 10, nprobe=4, skip_same=True))


@query("ivf_all_probes_recall", "SELECT 100.0::DOUBLE AS recall, count(*) AS n_queries FROM embeddings")
def ivf_all_probes_recall(spark, sf):
    base, centers, queries = i.vectors(spark, sf), i.class_centers(spark, sf), i.all_queries(spark, sf)
    held = shards.shard_vectors(base, shards.shard_points(base, centers, 2))
    found = shards.ivf_search(held, centers, queries, 10, nprobe=10, skip_same=True)
    truth = exact_knn(base, queries, 10, skip_same=True)
    return evaluate.recall(found, truth, 10).select(i.r6("recall").alias("recall"), "n_queries")


@query("ivf_pruned_top10", f"{BASE}, {NEAR}, p AS (SELECT DISTINCT q.id AS qid, b.id FROM a q JOIN a b ON q.cid = b.cid WHERE q.r <= 4 AND b.r <= 2 AND q.id <> b.id), "
       "s AS (SELECT qid, p.id, list_distance(q.vec, b.vec) ** 2 AS dist FROM p JOIN v q ON q.id = qid JOIN v b ON b.id = p.id) " + i.topk_sql("SELECT * FROM s", 10))
def ivf_pruned_top10(spark, sf):
    """The rows of ``ivf_top10`` from a layout on disk."""
    base, centers, path = i.vectors(spark, sf), i.class_centers(spark, sf), new_path(spark, "ivf")
    shards.write_ivf(base, centers, path, 2)
    return i.shown(shards.ivf_search_pruned(path, centers, i.all_queries(spark, sf), 10, nprobe=4, skip_same=True))


@query("split_to_budget", "SELECT true AS fits, true AS few_fits, true AS covers_overlap, count(*) AS n FROM embeddings")
def split_to_budget(spark, sf):
    """Shards of at most an eighth of the rows, each row in two of them."""
    base = stored(i.vectors(spark, sf), "base")
    n = base.count()
    budget = shards.shard_bytes(n // 8, 64, 32)
    centers, estimate, fits = shards.split_to_budget(base, budget, 32, k_base=2, rate=0.5)
    sizes = shards.shard_points(base, centers, 2).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    few = fits <= 2 + math.ceil(math.log2(centers.count()))
    held = estimate.agg(F.max("estimate").alias("largest")).crossJoin(sizes.agg(F.sum("n").alias("total")))  # one row each
    return held.select((F.col("largest") <= n // 8).alias("fits"), F.lit(few).alias("few_fits"),
                       (F.col("total") == 2 * n).alias("covers_overlap"), F.lit(n).cast("long").alias("n"))
