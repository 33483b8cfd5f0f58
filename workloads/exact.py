"""Exact search: joins, filters, top-k, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators import knn, lookups, pruned
from vecloom.operators.ranges import range_join

from . import inputs as i
from .registry import query

PAIR = "SELECT q.id AS qid, b.id, {d} AS dist FROM {q} q JOIN {b} b ON q.id <> b.id"
L2 = "list_distance(q.vec, b.vec) ** 2"
ALL_L2 = PAIR.format(d=L2, q="v", b="v")


@query("l2_top10", f"WITH {i.SQL_VECTORS} " + i.topk_sql(ALL_L2, 10))
def l2_top10(spark, sf):
    return i.shown(knn.exact_knn(i.vectors(spark, sf), i.all_queries(spark, sf), 10, "l2", skip_same=True))


@query("mips_top10", f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED} " + i.topk_sql(
    PAIR.format(d="-list_inner_product(q.vec, b.vec)", q="v", b="s"), 10))
def mips_top10(spark, sf):
    return i.shown(knn.exact_knn(i.scaled(spark, sf), i.all_queries(spark, sf), 10, "mips", skip_same=True))


@query("cosine_top10", f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED} " + i.topk_sql(
    PAIR.format(d="1 - list_cosine_similarity(q.vec, b.vec)", q="v", b="s"), 10))
def cosine_top10(spark, sf):
    return i.shown(knn.exact_knn(i.scaled(spark, sf), i.all_queries(spark, sf), 10, "cosine", skip_same=True))


@query("int8_l2_top10", f"WITH {i.SQL_VECTORS}, n AS (SELECT id, list_transform(vec, lambda x: round(x * 127)) AS vec FROM v) "
       + i.topk_sql(PAIR.format(d="round(" + L2 + ")", q="n", b="n"), 10))
def int8_l2_top10(spark, sf):
    base = i.int8_vectors(spark, sf)
    queries = base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return i.shown(knn.exact_knn(base, queries, 10, "l2", skip_same=True))


@query("label_mean_top10", f"WITH {i.SQL_VECTORS}, {i.SQL_CENTERS} " + i.topk_sql(
    "SELECT q.cid AS qid, b.id, list_distance(q.vec, b.vec) ** 2 AS dist FROM c q CROSS JOIN v b", 10))
def label_mean_top10(spark, sf):
    queries = i.class_centers(spark, sf).select(F.col("cid").alias("qid"), F.col("vec").alias("qvec"))
    return i.shown(knn.exact_knn(i.vectors(spark, sf), queries, 10, "l2"))


def _tags(spark, sf):
    return i.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") == 0, 0).otherwise(F.col("vec_id") + 1000).alias("tag"))


@query("tagged_top10", f"WITH {i.SQL_VECTORS}, s AS (SELECT * FROM v WHERE label <> 0) " + i.topk_sql(
    PAIR.format(d=L2, q="v", b="s"), 10, ", id + 1000 AS tag"))
def tagged_top10(spark, sf):
    return i.shown(knn.exact_knn(
        i.vectors(spark, sf), i.all_queries(spark, sf), 10, tags=_tags(spark, sf), skip_same=True))


@query("filtered_top10", f"WITH {i.SQL_VECTORS}, {i.SQL_LABELLED}, s AS (SELECT * FROM pl WHERE "
       "list_contains(labels, 'by_3') OR list_contains(labels, 'all')) " + i.topk_sql(PAIR.format(d=L2, q="v", b="s"), 10))
def filtered_top10(spark, sf):
    return i.shown(knn.exact_knn(
        i.labelled(spark, sf), i.all_queries(spark, sf), 10, label="by_3", universal="all", skip_same=True))


@query("per_query_label_top10", f"WITH {i.SQL_LABELLED} " + i.topk_sql(
    f"SELECT q.id AS qid, b.id, {L2} AS dist FROM pl q JOIN pl b ON q.id <> b.id AND "
    "(list_contains(b.labels, q.labels[1]) OR list_contains(b.labels, 'all'))", 10))
def per_query_label_top10(spark, sf):
    base = i.labelled(spark, sf)
    queries = base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("labels")[0].alias("label"))
    return i.shown(knn.exact_knn_by_label(base, queries, 10, universal="all", skip_same=True))


RANGE = 1.3


@query("range_l2", f"WITH {i.SQL_VECTORS} SELECT qid, id, round(dist, 6) AS dist FROM ({ALL_L2}) WHERE dist <= {RANGE}")
def range_l2(spark, sf):
    found = range_join(
        i.vectors(spark, sf), i.all_queries(spark, sf), RANGE, centers=i.class_centers(spark, sf), skip_same=True)
    return found.withColumn("dist", i.r6("dist"))


@query("range_cosine", f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED} SELECT qid, id, round(dist, 6) AS dist FROM ("
       + PAIR.format(d="1 - list_cosine_similarity(q.vec, b.vec)", q="v", b="s") + ") WHERE dist <= 0.5")
def range_cosine(spark, sf):
    found = range_join(i.scaled(spark, sf), i.all_queries(spark, sf), 0.5, "cosine", skip_same=True)
    return found.withColumn("dist", i.r6("dist"))


@query("merge_topk", f"WITH {i.SQL_VECTORS} SELECT qid, rank, id, round(dist, 6) AS dist, part AS partition FROM (SELECT *, "
       "row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM ("
       f"SELECT q.id AS qid, b.id, (b.label % 2)::BIGINT AS part, {L2} AS dist FROM v q JOIN v b ON q.id <> b.id)) WHERE rank <= 10")
def merge_topk(spark, sf):
    e, queries = i.table(spark, sf, "embeddings"), i.all_queries(spark, sf)
    parts = [
        knn.exact_knn(e.where(F.col("label") % 2 == p).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")),
                      queries, 10, skip_same=True)
        for p in (0, 1)
    ]
    merged = i.shown(knn.merge_topk(parts, 10))
    return merged.withColumn("partition", F.col("partition").cast("long"))


TOP3 = f"WITH {i.SQL_VECTORS}, t AS (" + i.topk_sql(ALL_L2, 3) + ") "


def _top3(spark, sf):
    return i.shown(knn.exact_knn(i.vectors(spark, sf), i.all_queries(spark, sf), 3, skip_same=True))


@query("lookup_tags", TOP3 + "SELECT t.*, CASE WHEN label <> 0 THEN id + 1000 END AS tag FROM t JOIN v USING (id)")
def lookup_tags(spark, sf):
    return lookups.lookup_tags(_top3(spark, sf), _tags(spark, sf).where("tag <> 0")).select("qid", "rank", "id", "dist", "tag")


@query("with_vectors", TOP3 + "SELECT t.*, round(list_sum(vec), 6) AS vec_sum FROM t JOIN v USING (id)")
def with_vectors(spark, sf):
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return lookups.with_vectors(_top3(spark, sf), i.vectors(spark, sf)).select(
        "qid", "rank", "id", "dist", i.r6(total).alias("vec_sum"))


@query("get_by_tag", "WITH asked AS (SELECT event_id AS tag FROM events) SELECT tag, round(list_sum(embedding::DOUBLE[]), 6) "
       "AS vec_sum, CASE WHEN vec_id IS NULL THEN -1 ELSE 0 END AS status FROM asked LEFT JOIN embeddings ON vec_id + 1000 = tag")
def get_by_tag(spark, sf):
    points = i.vectors(spark, sf).select((F.col("id") + 1000).alias("tag"), "vec")
    asked = i.table(spark, sf, "events").select(F.col("event_id").alias("tag"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return lookups.get_by_tag(points, asked).select("tag", i.r6(total).alias("vec_sum"), "status")


@query("l2_top10_pruned", f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED}, r AS ({i.topk_sql(PAIR.format(d=L2, q='s', b='s'), 10)}) SELECT *, true AS fewer_pairs FROM r")
def l2_top10_pruned(spark, sf):
    """Vectors of norms 1 to 7 among themselves; cells beyond a query's tenth neighbour are not met."""
    base = i.scaled(spark, sf)
    found, work = pruned.pruned_knn(base, base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 10, skip_same=True)
    fewer = work.select((F.col("scored") < 0.9 * F.col("all_pairs")).alias("fewer_pairs"))
    return i.shown(found).crossJoin(fewer)  # one row


@query("range_l2_rings", f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED} SELECT q.id AS qid, b.id, round(list_distance(q.vec, b.vec) ** 2, 6) AS dist FROM s q JOIN s b ON q.id <> b.id WHERE list_distance(q.vec, b.vec) ** 2 <= 3.0000001")
def range_l2_rings(spark, sf):
    """A range join over rings of distances around the class means."""
    base = i.scaled(spark, sf)
    asked = base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    found = range_join(base, asked, 3.0000001, centers=i.class_centers(spark, sf), skip_same=True)
    return found.select("qid", "id", i.r6("dist").alias("dist"))
