"""Product quantization with a codebook both engines can compute: the chunks of the class means."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators import lookups, pq, pq_all
from vecloom.operators.knn import exact_knn
from vecloom.plans.scratch import stored
from vecloom.plans.sums import vector_means

from . import inputs as i
from .registry import query

N = 8
MEAN = "mu AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM el GROUP BY pos))"
BASE = (f"WITH {i.SQL_VECTORS}, {i.SQL_CENTERS}, {MEAN}, ch AS (SELECT unnest(range(0, 8)) AS chunk), "
        "x AS (SELECT id, label, vec AS raw, list_transform(list_zip(vec, mean), lambda z: z[1] - z[2]) AS vec FROM v, mu), "
        "cb AS (SELECT chunk, cid AS code, list_transform(list_zip(vec, mean), lambda z: z[1] - z[2])[chunk * 8 + 1 : chunk * 8 + 8] AS part FROM c, mu, ch)")
CODES = ("xc AS (SELECT id, chunk, vec[chunk * 8 + 1 : chunk * 8 + 8] AS part, raw[chunk * 8 + 1 : chunk * 8 + 8] AS rawpart FROM x, ch), "
         "codes AS (SELECT id, chunk, arg_min(code, list_distance(xc.part, cb.part)) AS code FROM xc JOIN cb USING (chunk) GROUP BY id, chunk)")
ADC = "adc AS (SELECT id AS qid, chunk, code, list_distance(xc.part, cb.part) ** 2 AS value FROM xc JOIN cb USING (chunk))"
SCORED = "sc AS (SELECT qid, codes.id, sum(value) AS dist FROM adc JOIN codes USING (chunk, code) WHERE qid <> codes.id GROUP BY qid, codes.id)"


def quantizer(spark, sf) -> pq.Quantizer:
    centers = i.class_centers(spark, sf)
    mean = stored(vector_means(i.vectors(spark, sf).withColumn("g", F.lit(0)), "g").select("vec"), "mean")
    moved = centers.crossJoin(F.broadcast(mean.withColumnRenamed("vec", "mean"))).select(  # one row
        "cid", F.zip_with("vec", "mean", lambda x, m: x - m).alias("vec"))
    chunks = pq.pq_chunks(spark, 64, N)
    book = moved.crossJoin(F.broadcast(chunks)).select(  # 8 rows
        "chunk", F.col("cid").cast("int").alias("code"), F.expr("slice(vec, lo + 1, hi - lo)").alias("centroid"))
    return pq.Quantizer(chunks, stored(book, "book"), mean)


@query("pq_layout", "SELECT chunk, chunk * (d // 7) + least(chunk, d % 7) AS lo, (chunk + 1) * (d // 7) + least(chunk + 1, d % 7) AS hi "
       "FROM (SELECT max(len(embedding)) AS d FROM embeddings), (SELECT unnest(range(0, 7)) AS chunk)")
def pq_layout(spark, sf):
    dim = i.vectors(spark, sf).agg(F.max(F.size("vec"))).first()[0]
    return pq.pq_chunks(spark, dim, 7).select(*[F.col(c).cast("long").alias(c) for c in ("chunk", "lo", "hi")])


@query("pq_plan", "SELECT count(*) AS n, 0.00001 * 1073741824 AS budget_bytes, greatest(1, least(floor(0.00001 * 1073741824 / count(*)), 64, 512))::BIGINT AS chunks FROM embeddings")
def pq_plan(spark, sf):
    return pq.pq_plan(i.vectors(spark, sf), 64, 0.00001)


@query("pq_encode", f"{BASE}, {CODES} SELECT id, string_agg(code::VARCHAR, ',' ORDER BY chunk) AS codes FROM codes GROUP BY id")
def pq_encode(spark, sf):
    codes = pq.pq_encode(i.vectors(spark, sf), quantizer(spark, sf))
    return codes.select("id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query("get_codes", f"{BASE}, {CODES} SELECT id, string_agg(code::VARCHAR, ',' ORDER BY chunk) AS codes FROM codes JOIN (SELECT DISTINCT event_id FROM events) ON event_id = id GROUP BY id")
def get_codes(spark, sf):
    codes = pq.pq_encode(i.vectors(spark, sf), quantizer(spark, sf))
    asked = i.table(spark, sf, "events").select(F.col("event_id").alias("id")).distinct()
    return lookups.get_codes(codes, asked).select("id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query("pq_decode", f"{BASE}, {CODES} SELECT id, chunk * 8 + p - 1 AS pos, round(part[p] + mean[chunk * 8 + p], 6) AS x FROM codes JOIN cb USING (chunk, code), mu, (SELECT unnest(range(1, 9)) AS p)")
def pq_decode(spark, sf):
    q = quantizer(spark, sf)
    out = pq.pq_decode(pq.pq_encode(i.vectors(spark, sf), q), q)
    return out.select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), i.r6("x").alias("x"))


@query("reconstruction_error", f"{BASE}, {CODES} SELECT count(DISTINCT id) AS n, round(sum(list_distance(xc.part, cb.part) ** 2) / count(DISTINCT id), 6) AS mean_error "
       "FROM xc JOIN codes USING (id, chunk) JOIN cb USING (chunk, code)")
def reconstruction_error(spark, sf):
    q, base = quantizer(spark, sf), i.vectors(spark, sf)
    return pq.reconstruction_error(base, pq.pq_encode(base, q), q).select("n", i.r6("mean_error").alias("mean_error"))


@query("adc_table_l2", f"{BASE}, {CODES}, {ADC} SELECT qid, chunk, code, round(value, 6) AS value FROM adc")
def adc_table_l2(spark, sf):
    t = pq.adc_table(i.all_queries(spark, sf), quantizer(spark, sf))
    return t.select("qid", F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"), i.r6("value").alias("value"))


@query("adc_table_ip", f"{BASE}, {CODES} SELECT id AS qid, chunk, code, round(-list_inner_product(rawpart, cb.part), 6) + 0.0 AS value FROM xc JOIN cb USING (chunk)")
def adc_table_ip(spark, sf):
    t = pq.adc_table(i.all_queries(spark, sf), quantizer(spark, sf), "mips")
    return t.select("qid", F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"), i.r6("value").alias("value"))


# Codes repeat, so distances tie; both sides rank on a 9-digit grid.
@query("adc_scan", f"{BASE}, {CODES}, {ADC}, {SCORED} SELECT qid, rank, id, round(d, 6) AS dist FROM (SELECT qid, id, dist AS d, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS rank FROM sc) WHERE rank <= 10")
def adc_scan(spark, sf):
    q = quantizer(spark, sf)
    codes = pq.pq_encode(i.vectors(spark, sf), q)
    return i.shown(pq.adc_scan(i.all_queries(spark, sf), codes, q, 10, skip_same=True))


def _class_pairs(spark, sf, q):
    base = i.vectors(spark, sf)
    labels = i.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("qid"))
    means = i.class_centers(spark, sf).select(F.col("cid").alias("qid"), F.col("vec").alias("qvec"))
    return pq.pq_encode(base, q).join(labels, "id").join(means, "qid")


@query("pq_distance_l2", f"{BASE}, {CODES} SELECT v.label::BIGINT AS qid, codes.id, round(sum(list_distance(qb.part, cb.part) ** 2), 6) AS dist "
       "FROM codes JOIN v USING (id) JOIN cb USING (chunk, code) JOIN cb qb ON qb.chunk = codes.chunk AND qb.code = v.label GROUP BY ALL")
def pq_distance_l2(spark, sf):
    q = quantizer(spark, sf)
    return pq.pq_distance(_class_pairs(spark, sf, q), q).withColumn("dist", i.r6("dist"))


@query("pq_distance_ip", f"{BASE}, {CODES} SELECT v.label::BIGINT AS qid, codes.id, round(sum(-list_inner_product(c.vec[codes.chunk * 8 + 1 : codes.chunk * 8 + 8], cb.part)), 6) AS dist "
       "FROM codes JOIN v USING (id) JOIN cb USING (chunk, code) JOIN c ON c.cid = v.label GROUP BY ALL")
def pq_distance_ip(spark, sf):
    q = quantizer(spark, sf)
    return pq.pq_distance(_class_pairs(spark, sf, q), q, "mips").withColumn("dist", i.r6("dist"))


@query("pq_preprocess", f"{BASE} SELECT id AS qid, pos - 1 AS pos, round(x.vec[pos], 6) AS x FROM x, (SELECT unnest(range(1, 65)) AS pos)")
def pq_preprocess(spark, sf):
    """Centred and turned by a rotation that shifts the axes by one, then turned back for the check."""
    q = quantizer(spark, sf)
    q.rotation = spark.range(64).select(
        F.col("id").cast("int").alias("row"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: (c == (F.col("id") + 1) % 64).cast("double")).alias("vec"))
    out = pq.pq_preprocess(i.all_queries(spark, sf), q)
    return out.select("qid", F.posexplode("qvec").alias("pos", "x")).select(
        "qid", ((F.col("pos") + 63) % 64).cast("long").alias("pos"), i.r6("x").alias("x"))


@query("pq_search", f"{BASE}, {CODES}, {ADC}, {SCORED}, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS r FROM sc) WHERE r <= 30), "
       "ex AS (SELECT qid, cand.id, list_distance(q.vec, b.vec) ** 2 AS dist FROM cand JOIN v q ON q.id = qid JOIN v b ON b.id = cand.id) " + i.topk_sql("SELECT * FROM ex", 10))
def pq_search(spark, sf):
    q, base = quantizer(spark, sf), i.vectors(spark, sf)
    return i.shown(pq.pq_search(i.all_queries(spark, sf), pq.pq_encode(base, q), base, q, 10, mult=3, skip_same=True))


@query("pq_trained_search", "SELECT count(*) AS n_queries, true AS good_recall FROM embeddings")
def pq_trained_search(spark, sf):
    from vecloom.operators.evaluate import recall
    base, queries = i.vectors(spark, sf), i.all_queries(spark, sf)
    q = pq.pq_train(base, 16, seed=2)
    found = pq.pq_search(queries, stored(pq.pq_encode(base, q), "codes"), base, q, 10, mult=3, skip_same=True)
    truth = exact_knn(base, queries, 10, skip_same=True)
    return recall(found, truth, 10).select("n_queries", (F.col("recall") >= 70).alias("good_recall"))


@query("pq_train", "SELECT 8::BIGINT AS chunks, true AS full_codebook, true AS improves, count(*) AS n FROM embeddings")
def pq_train(spark, sf):
    base = i.vectors(spark, sf)
    q = pq.pq_train(base, N, seed=2)
    return _trained(base, q)


@query("pq_train_uncentred", "SELECT 8::BIGINT AS chunks, true AS full_codebook, true AS improves, count(*) AS n FROM embeddings")
def pq_train_uncentred(spark, sf):
    base = i.vectors(spark, sf)
    return _trained(base, pq.pq_train(base, N, center=False, seed=2))


@query("opq_train", "SELECT 8::BIGINT AS chunks, true AS full_codebook, true AS improves, count(*) AS n FROM embeddings")
def opq_train(spark, sf):
    base = i.vectors(spark, sf)
    return _trained(base, pq.opq_train(base, N, rounds=3, seed=2))


def _trained(base, q):
    """Codes of a trained quantizer must restore the vectors better than their mean does."""
    error = pq.reconstruction_error(base, pq.pq_encode(base, q), q)
    book = q.codebook.agg(F.count_distinct("chunk").alias("chunks"), F.count(F.lit(1)).alias("_rows"))
    return error.crossJoin(book).select(
        "chunks", (F.col("_rows") == N * 256).alias("full_codebook"), (F.col("mean_error") < 0.5).alias("improves"), "n")


@query("pq_lloyd_step", f"{BASE}, {CODES}, xe AS (SELECT codes.chunk, codes.code, xc.part FROM codes JOIN xc USING (id, chunk)), "
       "pe AS (SELECT chunk, code, generate_subscripts(part, 1) - 1 AS pos, unnest(part) AS x FROM xe) "
       "SELECT chunk, code::BIGINT AS code, pos, count(*) AS n, round(avg(x), 6) + 0.0 AS x FROM pe GROUP BY chunk, code, pos")
def pq_lloyd_step(spark, sf):
    """One step of all chunks over all rows, from a given codebook."""
    base, q = i.vectors(spark, sf), quantizer(spark, sf)
    step = pq_all.chunk_sums(base, q)
    return step.select(
        F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"), "n", F.posexplode("sums").alias("pos", "x")).select(
        "chunk", "code", F.col("pos").cast("long").alias("pos"), "n", i.r6(F.col("x") / F.col("n")).alias("x"))


@query("pq_train_all", "SELECT count(*) AS n, 64::BIGINT AS most_codes, true AS no_worse_than_sampled, true AS error_falls FROM embeddings")
def pq_train_all(spark, sf):
    """Training on every row, held against training on a fifth of them."""
    base = stored(i.vectors(spark, sf), "base")
    n = base.count()
    every, errors = pq_all.pq_train_all(base, N, centers=64, reps=6)
    some = pq.pq_train(base, N, centers=64, reps=6, rows=n // 5)
    error = [pq.reconstruction_error(base, pq.pq_encode(base, q), q).select("n", F.col("mean_error").alias(name))
             for q, name in ((every, "all_error"), (some, "some_error"))]
    falls = all(b <= a * (1 + 1e-9) for a, b in zip(errors, errors[1:]))
    codes = every.codebook.agg((F.max("code") + 1).cast("long").alias("most_codes"))
    return error[0].crossJoin(error[1].drop("n")).crossJoin(codes).select(  # one row each
        "n", "most_codes", (F.col("all_error") <= F.col("some_error")).alias("no_worse_than_sampled"), F.lit(falls).alias("error_falls"))
