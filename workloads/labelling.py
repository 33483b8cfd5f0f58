"""Label jobs over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators import labels as lab
from vecloom.operators.knn import exact_knn
from vecloom.operators.shards import shard_points

from . import inputs as i
from .registry import query

DOCS = f"WITH {i.SQL_DOC_LABELS}, pl AS (SELECT id, generate_subscripts(labels, 1) - 1 AS pos, unnest(labels) AS label FROM dl) "
VECS = f"WITH {i.SQL_LABELLED}, ex AS (SELECT id, generate_subscripts(labels, 1) - 1 AS pos, unnest(labels) AS label FROM pl) "
DICT = ("f AS (SELECT label, min(id * 100 + pos) AS first FROM ex WHERE label <> 'all' GROUP BY label), "
        "dict AS (SELECT label, 1 + row_number() OVER (ORDER BY first) AS code FROM f UNION ALL SELECT 'all', 0) ")


@query("label_dict", DOCS + "SELECT label, row_number() OVER (ORDER BY first) AS code FROM (SELECT label, min(id * 10 + pos) AS first FROM pl GROUP BY label)")
def label_dict(spark, sf):
    return lab.label_dictionary(i.document_labels(spark, sf))


@query("encode_labels", VECS + f", {DICT} SELECT id, string_agg(code::VARCHAR, ',' ORDER BY pos) AS codes FROM ex JOIN dict USING (label) GROUP BY id")
def encode_labels(spark, sf):
    coded, _ = lab.encode_labels(i.labelled(spark, sf), "all")
    return coded.select("id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query("decode_labels", VECS + "SELECT id, string_agg(label, ',' ORDER BY pos) AS labels FROM ex GROUP BY id")
def decode_labels(spark, sf):
    coded, dictionary = lab.encode_labels(i.labelled(spark, sf), "all")
    return lab.decode_labels(coded, dictionary).select("id", F.array_join("labels", ",").alias("labels"))


@query("default_labels", "SELECT doc_id AS id, CASE WHEN quality IS NULL THEN 'default' ELSE quality::VARCHAR END AS labels FROM documents LEFT JOIN labels USING (doc_id)")
def default_labels(spark, sf):
    docs = i.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    marked = i.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.array(F.col("quality").cast("string")).alias("labels"))
    return lab.default_labels(docs.join(marked, "id", "left")).select("id", F.array_join("labels", ",").alias("labels"))


@query("label_counts", DOCS + "SELECT label, count(*) AS n FROM pl GROUP BY label")
def label_counts(spark, sf):
    return lab.label_counts(i.document_labels(spark, sf))


@query("expand_universal", VECS + ", every AS (SELECT string_agg(DISTINCT label, ',' ORDER BY label) AS e FROM ex WHERE label <> 'all') "
       "SELECT id, CASE WHEN list_contains(labels, 'all') THEN e ELSE array_to_string(labels, ',') END AS labels FROM pl, every")
def expand_universal(spark, sf):
    return lab.expand_universal(i.labelled(spark, sf), "all").select("id", F.array_join("labels", ",").alias("labels"))


@query("labels_match", VECS + ", p AS (SELECT pl.id, pl.labels AS point, ['by_3', 'l' || (pl.id % 10)::VARCHAR] AS wanted FROM pl) "
       "SELECT id, list_has_any(point, wanted) OR list_contains(point, 'all') AS at_search, "
       "list_has_any(point, wanted) OR list_contains(point, 'all') OR list_contains(wanted, 'all') AS at_build FROM p")
def labels_match(spark, sf):
    wanted = F.array(F.lit("by_3"), F.concat(F.lit("l"), (F.col("id") % 10).cast("string")))
    return i.labelled(spark, sf).select(
        "id", lab.labels_match(F.col("labels"), wanted, "all").alias("at_search"),
        lab.labels_match(F.col("labels"), wanted, "all", build=True).alias("at_build"))


@query("resolve_query_label", VECS + f", {DICT} SELECT doc_id AS qid, source AS label, coalesce(code, 0) AS code, CASE WHEN code IS NULL THEN 'universal' ELSE 'known' END AS status "
       "FROM documents LEFT JOIN dict ON dict.label = source")
def resolve_query_label(spark, sf):
    _, dictionary = lab.encode_labels(i.labelled(spark, sf), "all")
    asked = i.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("label"))
    return lab.resolve_query_label(asked, dictionary, "all").select("qid", "label", "code", "status")


@query("label_stats", VECS + ", n AS (SELECT label, count(*) AS n FROM ex GROUP BY label), o AS (SELECT label, n, row_number() OVER (ORDER BY n, label) - 1 AS r, count(*) OVER () AS m FROM n) "
       "SELECT stat, label, round(value, 6) AS value FROM ("
       "SELECT printf('p%02d', p) AS stat, label, n::DOUBLE AS value FROM o JOIN (SELECT unnest(range(0, 100, 5)) AS p) ON r = (p * m) // 100 "
       "UNION ALL SELECT 'top' || (m - r)::VARCHAR, label, n FROM o WHERE r >= m - 3 "
       "UNION ALL SELECT unnest(['points', 'labels_per_point', 'dense_fraction']), NULL, unnest([count(*)::DOUBLE, avg(len(labels)), avg((len(labels) >= 3)::INT)]) FROM pl "
       "UNION ALL SELECT unnest(['n_labels', 'mean_label_size']), NULL, unnest([count(*)::DOUBLE, avg(n)]) FROM n)")
def label_stats(spark, sf):
    return lab.label_stats(i.labelled(spark, sf), 3).withColumn("value", i.r6("value"))


@query("split_by_label", DOCS + "SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS local_id FROM (SELECT DISTINCT label, id FROM pl)")
def split_by_label(spark, sf):
    docs = i.document_labels(spark, sf).join(i.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("n_chars").alias("vec")), "id")
    return lab.split_by_label(docs).select("label", "id", "local_id")


@query("label_entry_points", VECS + "SELECT label, true AS carries_label, 1::BIGINT AS n_starts FROM ex GROUP BY label")
def label_entry_points(spark, sf):
    df = i.labelled(spark, sf)
    starts = lab.label_entry_points(df, seed=5)
    carried = starts.join(df.select("id", "labels"), "id").withColumn("ok", F.array_contains("labels", F.col("label")))
    return carried.groupBy("label").agg(F.bool_and("ok").alias("carries_label"), F.count(F.lit(1)).alias("n_starts"))


PIECES = ("px AS (SELECT id, pos // 2 AS piece, string_agg(label, ',' ORDER BY pos) AS labels FROM ex GROUP BY ALL), "
          "cl AS (SELECT id, piece, labels, (SELECT max(id) FROM pl) + row_number() OVER (ORDER BY id, piece) AS clone FROM px WHERE piece > 0) ")


@query("dense_split", VECS + f", {PIECES} SELECT id, labels, NULL::BIGINT AS clone_of FROM px WHERE piece = 0 UNION ALL SELECT clone, labels, id FROM cl")
def dense_split(spark, sf):
    rows, clones = lab.breakup_dense(i.labelled(spark, sf), 2)
    real = clones.select(F.col("clone").alias("id"), F.col("id").alias("clone_of"))
    return rows.join(real, "id", "left").select("id", F.array_join("labels", ",").alias("labels"), "clone_of")


@query("undummy", VECS + f", {PIECES}, b AS (SELECT id, vec, id AS real FROM pl UNION ALL SELECT clone, vec, cl.id FROM cl JOIN pl ON pl.id = cl.id), "
       "t AS (SELECT * FROM (SELECT q.id AS qid, b.real, list_distance(q.vec, b.vec) ** 2 AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, b.vec) ** 2, b.id) AS r "
       "FROM pl q JOIN b ON q.id <> b.id) WHERE r <= 10), m AS (SELECT qid, real, min(d) AS d FROM t GROUP BY ALL) "
       "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, real) AS rank, real AS id, round(d, 6) AS dist FROM m")
def undummy(spark, sf):
    rows, clones = lab.breakup_dense(i.labelled(spark, sf), 2)
    found = exact_knn(rows.select("id", "vec"), i.all_queries(spark, sf), 10, skip_same=True)
    return i.shown(lab.undummy(found, clones))


@query("shard_labels", VECS.rstrip() + f", {i.SQL_VECTORS}, {i.SQL_CENTERS}, m AS (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY list_distance(v.vec, c.vec), cid) AS r FROM v, c) "
       "SELECT cid AS shard, id, array_to_string(labels, ',') AS labels FROM m JOIN pl USING (id) WHERE r <= 2")
def shard_labels(spark, sf):
    shard_map = shard_points(i.vectors(spark, sf), i.class_centers(spark, sf), 2)
    return lab.shard_labels(shard_map, i.labelled(spark, sf)).select("shard", "id", F.array_join("labels", ",").alias("labels"))


@query("sample_query_labels", DOCS + "SELECT row_number() OVER (ORDER BY h, id, pos) AS draw, label FROM (SELECT *, md5('11|' || id || '|' || pos) AS h FROM pl) QUALIFY draw <= 100")
def sample_query_labels(spark, sf):
    drawn = lab.sample_query_labels(i.document_labels(spark, sf), 100, seed=11)
    return drawn.select(F.col("draw").cast("long").alias("draw"), "label")


@query("merge_label_starts", DOCS + ", loc AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS local_id FROM (SELECT DISTINCT label, id FROM pl)) "
       "SELECT label, id FROM loc WHERE local_id = 0")
def merge_label_starts(spark, sf):
    """Each label is one shard; its start is its first local point."""
    docs = i.document_labels(spark, sf).withColumn("vec", F.array(F.lit(0.0)))
    parts = lab.split_by_label(docs).withColumn("shard", F.col("label"))
    starts = parts.groupBy("shard", "label").agg(F.min("local_id").alias("local_id"))
    return lab.merge_label_starts(starts, parts.select("shard", "local_id", "id"))
