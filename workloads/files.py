"""Sources and sinks: what is written and read back must be the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators.knn import exact_knn
from vecloom.operators.ranges import range_join
from vecloom.plans.scratch import new_path, stored
from vecloom.sources import snapshot, synthetic, textfiles, truthfiles, vecfiles

from . import inputs as i
from .exact import ALL_L2
from .graphs import EDGES, neighbours
from .registry import query

CELLS = f"WITH {i.SQL_VECTORS} SELECT id, pos - 1 AS pos, round(vec[pos], 6) AS x FROM v, (SELECT unnest(range(1, 65)) AS pos)"


def _cells(df):
    return df.select("id", F.posexplode("vec").alias("pos", "x")).select(
        "id", F.col("pos").cast("long").alias("pos"), i.r6(F.col("x").cast("double")).alias("x"))


def _round_trip(kind, dtype=None, **options):
    def run(spark, sf):
        path = new_path(spark, kind)
        vecfiles.write_vectors(i.vectors(spark, sf), path, kind, dtype, rows_per_file=150)
        return _cells(vecfiles.read_vectors(spark, path, kind, dtype, **options))
    return run


query("bin_round_trip", CELLS)(_round_trip("bin"))
query("fvecs_round_trip", CELLS)(_round_trip("fvecs"))
query("bin_part_load", CELLS + " WHERE id >= 120 AND id < 320")(_round_trip("bin", offset=120, limit=200))


@query("bvecs_round_trip", f"WITH {i.SQL_VECTORS} SELECT id, pos - 1 AS pos, (round(vec[pos] * 100) + 128)::DOUBLE AS x FROM v, (SELECT unnest(range(1, 65)) AS pos)")
def bvecs_round_trip(spark, sf):
    path = new_path(spark, "bvecs")
    df = i.vectors(spark, sf).withColumn("vec", F.transform("vec", lambda x: (F.round(x.cast("double") * 100) + 128).cast("smallint")))
    vecfiles.write_vectors(df, path, "bvecs", rows_per_file=200)
    return _cells(vecfiles.read_vectors(spark, path, "bvecs"))


@query("ivecs_round_trip", f"{EDGES} SELECT src AS id, r - 1 AS pos, dst::DOUBLE AS x FROM rk WHERE r <= 8")
def ivecs_round_trip(spark, sf):
    """Neighbour ids as rows of integers."""
    path = new_path(spark, "ivecs")
    lists = neighbours(spark, sf).groupBy(F.col("src").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("c")).select(
        "id", F.transform("c", lambda c: c["dst"].cast("int")).alias("vec"))
    vecfiles.write_vectors(lists, path, "ivecs", rows_per_file=100)
    return _cells(vecfiles.read_vectors(spark, path, "ivecs"))


@query("int8_bin_round_trip", f"WITH {i.SQL_VECTORS} SELECT id, pos - 1 AS pos, round(vec[pos] * 127)::DOUBLE + 0.0 AS x FROM v, (SELECT unnest(range(1, 65)) AS pos)")
def int8_bin_round_trip(spark, sf):
    path = new_path(spark, "int8")
    vecfiles.write_vectors(i.int8_vectors(spark, sf), path, "bin", "int8")
    return _cells(vecfiles.read_vectors(spark, path, "bin", "int8").withColumn("vec", F.col("vec").cast("array<double>")))


@query("tsv_round_trip", CELLS)
def tsv_round_trip(spark, sf):
    path = new_path(spark, "tsv")
    textfiles.write_tsv(i.vectors(spark, sf).repartition(3), path)
    return _cells(textfiles.read_tsv(spark, path, 64))


@query("label_file_round_trip", f"WITH {i.SQL_LABELLED} SELECT id, array_to_string(list_sort(labels), ',') AS labels FROM pl")
def label_file_round_trip(spark, sf):
    path = new_path(spark, "labels")
    textfiles.write_labels(i.labelled(spark, sf), path)
    return textfiles.read_labels(spark, path).select("id", F.array_join("labels", ",").alias("labels"))


@query("tag_file_round_trip", "SELECT vec_id AS id, vec_id * 3 + 1 AS tag FROM embeddings")
def tag_file_round_trip(spark, sf):
    path, base = new_path(spark, "tags"), i.vectors(spark, sf)
    vecfiles.write_tags(base.select("id", (F.col("id") * 3 + 1).alias("tag")), path)
    return vecfiles.read_tags(spark, path, base)


@query("truth_file_round_trip", f"WITH {i.SQL_VECTORS} SELECT qid, rank, id, dist FROM (" + i.topk_sql(ALL_L2, 10) + ")")
def truth_file_round_trip(spark, sf):
    path = new_path(spark, "truth")
    truth = stored(exact_knn(i.vectors(spark, sf), i.all_queries(spark, sf), 10, skip_same=True), "truth")
    truthfiles.write_truth(truth, path, queries_per_file=170)
    back = truthfiles.read_truth(spark, path)
    # float32 in the file, so compare what it holds with the table and report the table's distance
    near = back.withColumnRenamed("dist", "stored").join(truth, ["qid", "rank", "id"]).where(F.abs(F.col("stored") - F.col("dist")) < 1e-6)
    return near.select("qid", F.col("rank").cast("long").alias("rank"), "id", i.r6("dist").alias("dist"))


@query("range_truth_round_trip", f"WITH {i.SQL_VECTORS} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS pos FROM ({ALL_L2}) WHERE dist <= 1.4")
def range_truth_round_trip(spark, sf):
    path, queries = new_path(spark, "range-truth"), i.all_queries(spark, sf)
    truth = range_join(i.vectors(spark, sf), queries, 1.4, skip_same=True)
    truthfiles.write_range_truth(truth, queries, path, queries_per_file=170)
    return truthfiles.read_range_truth(spark, path)


@query("result_sink", f"WITH {i.SQL_VECTORS}, t AS (" + i.topk_sql(ALL_L2, 10) + ") SELECT \"L\", qid, rank, id, dist FROM t JOIN (SELECT unnest([5, 10])::BIGINT AS \"L\") ON rank <= \"L\"")
def result_sink(spark, sf):
    path = new_path(spark, "results")
    found = exact_knn(i.vectors(spark, sf), i.all_queries(spark, sf), 10, skip_same=True)
    lists = found.withColumn("L", F.explode(F.array(F.lit(5), F.lit(10)))).where("rank <= L")
    truthfiles.write_results(lists, path)
    return i.shown(spark.read.parquet(path)).withColumn("L", F.col("L").cast("long"))


@query("snapshot_round_trip", f"{EDGES}, d AS (SELECT id FROM v WHERE label = 5) SELECT v.id, v.id + 1 AS tag, round(list_sum(vec), 6) AS vec_sum, (SELECT count(*) FROM e WHERE src = v.id) AS degree, d.id IS NOT NULL AS deleted FROM v LEFT JOIN d USING (id)")
def snapshot_round_trip(spark, sf):
    """The delete list survives saving and loading."""
    path, base = new_path(spark, "snapshot"), i.vectors(spark, sf)
    tags = base.select("id", (F.col("id") + 1).alias("tag"))
    gone = i.table(spark, sf, "embeddings").where("label = 5").select(F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("tag"))
    for version in (1, 2):
        snapshot.save_snapshot(spark, path, version, {
            "vectors": base, "tags": tags, "labels": i.labelled(spark, sf).select("id", "labels"),
            "edges": neighbours(spark, sf), "tombstones": gone})
    t = snapshot.load_snapshot(spark, path)
    degree = t["edges"].groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return (
        t["vectors"].join(t["tags"], "id").join(degree, "id", "left")
        .join(t["tombstones"].select("id", F.lit(True).alias("deleted")), "id", "left")
        .select("id", "tag", i.r6(total).alias("vec_sum"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    )


@query("gen_vectors", "SELECT count(*) AS n, 16::BIGINT AS dim, true AS has_norm, true AS varied FROM embeddings")
def gen_vectors(spark, sf):
    """As many rows as there are embeddings."""
    n = i.vectors(spark, sf).count()
    rows = synthetic.gen_vectors(spark, n, 16, norm=3.0, seed=5)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).cast("long").alias("dim"),
        F.bool_and(F.abs(norm - 3.0) < 1e-5).alias("has_norm"), (F.count_distinct("vec") == F.count(F.lit(1))).alias("varied"))


@query("gen_int8_vectors", "SELECT count(*) AS n, 8::BIGINT AS dim, true AS in_range FROM embeddings")
def gen_int8_vectors(spark, sf):
    n = i.vectors(spark, sf).count()
    rows = synthetic.gen_vectors(spark, n, 8, "uint8", norm=100.0, seed=5)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).cast("long").alias("dim"),
        F.bool_and(F.forall("vec", lambda x: x.between(0, 255))).alias("in_range"))


@query("gen_labels", "SELECT unnest(['zipf', 'random', 'one_per_point']) AS dist, count(*) AS n, true AS all_labelled, true AS within_cap FROM embeddings")
def gen_labels(spark, sf):
    n = i.vectors(spark, sf).count()
    out = None
    for dist in ("zipf", "random", "one_per_point"):
        rows = synthetic.gen_labels(spark, n, 12, dist, seed=3)
        ones = F.count_if(F.array_contains("labels", "1"))
        cap = {"zipf": 0.7 * n, "random": n, "one_per_point": n}[dist]
        part = rows.agg(
            F.count(F.lit(1)).alias("n"), F.bool_and(F.size("labels") > 0).alias("all_labelled"), (ones <= cap).alias("within_cap")
        ).withColumn("dist", F.lit(dist))
        out = part if out is None else out.unionByName(part)
    return out


@query("snapshot_delta", f"WITH {i.SQL_VECTORS}, t(version) AS (VALUES (0), (1)) SELECT version::BIGINT AS version, id, round(list_sum(vec) * CASE WHEN version = 1 AND id % 100 = 0 THEN 2 ELSE 1 END, 6) AS vec_sum, true AS few_written FROM v, t")
def snapshot_delta(spark, sf):
    """Every hundredth vector is doubled before the second snapshot, which writes no bucket without one of these."""
    path, base = new_path(spark, "delta-snapshot"), i.vectors(spark, sf)
    n = base.count()
    first = snapshot.save_delta_snapshot(spark, path, 0, {"vectors": ("id", base)}, buckets=n)
    changed = base.withColumn("vec", F.when(F.col("id") % 100 == 0, F.transform("vec", lambda x: (x * 2).cast("float"))).otherwise(F.col("vec")))
    second = snapshot.save_delta_snapshot(spark, path, 1, {"vectors": ("id", changed)}, buckets=n)
    few = second["vectors"] <= -(-n // 100) < first["vectors"]
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    out = [snapshot.load_delta_snapshot(spark, path, v)["vectors"].select(
        F.lit(v).cast("long").alias("version"), "id", i.r6(total).alias("vec_sum"), F.lit(few).alias("few_written")) for v in (0, 1)]
    return out[0].unionByName(out[1])


@query("vecfile_stream", f"WITH {i.SQL_VECTORS} SELECT id, round(list_sum(vec), 6) AS vec_sum, least(id // 170, 2) AS batch FROM v")
def vecfile_stream(spark, sf):
    """Files that arrive one after the other, a micro-batch after each; ids go on over all of them."""
    path, out, ck = (new_path(spark, name) for name in ("arriving", "taken", "stream"))
    base = i.vectors(spark, sf)
    for part in range(3):
        mine = base.where(F.least(F.floor(F.col("id") / 170), F.lit(2)) == part)
        vecfiles.write_vectors(mine, f"{path}-{part}", "fvecs")
        vecfiles.arrive(f"{path}-{part}", path, f"day-{part}")

        def save(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        vecfiles.stream_vectors(spark, path, "fvecs").writeStream.foreachBatch(save).option(
            "checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(out).select("id", i.r6(total).alias("vec_sum"), F.col("batch").cast("long").alias("batch"))


@query("vecfile_id_range", CELLS + " WHERE id >= 120 AND id < 320")
def vecfile_id_range(spark, sf):
    path = new_path(spark, "bin")
    vecfiles.write_vectors(i.vectors(spark, sf), path, "bin", rows_per_file=150)
    return _cells(vecfiles.read_vector_range(spark, path, 120, 320))
