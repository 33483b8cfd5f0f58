"""Vector expressions and column transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions import distances as d
from vecloom.functions import precision, transforms, validate
from vecloom.operators.shards import assign_centers

from . import inputs as i
from .registry import query

# Every vector meets the mean of its own class: an equi-join, one pair per row.
PAIRED = f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED}, {i.SQL_CENTERS}, p AS (SELECT s.id, s.vec AS a, c.vec AS b FROM s JOIN v USING (id) JOIN c ON c.cid = v.label) "


def _paired(spark, sf):
    labels = i.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cid"))
    means = i.class_centers(spark, sf).select("cid", F.col("vec").alias("b"))
    return i.scaled(spark, sf).join(labels, "id").join(means, "cid").select("id", F.col("vec").alias("a"), "b")


def _pair_query(name, sql, column):
    @query(name, PAIRED + f"SELECT id, round({sql}, 6) AS dist FROM p")
    def run(spark, sf):
        return _paired(spark, sf).select("id", i.r6(column()).alias("dist"))


_pair_query("l2_distance", "list_distance(a, b) ** 2", lambda: d.l2sq("a", "b"))
_pair_query("ip_distance", "-list_inner_product(a, b)", lambda: d.ip_dist("a", "b"))
_pair_query("cosine_distance", "1 - list_cosine_similarity(a, b)", lambda: d.cos_dist("a", "b"))
_pair_query("callable_distance", "list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])))",
            lambda: d.distance(lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0),
                                                        lambda s, x: s + x), "a", "b"))
_pair_query("cosine_unit_distance", "1 - list_inner_product(list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))), b)",
            lambda: d.cos_dist_unit(transforms.normalized("a"), "b"))


@query("fast_l2_order", f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED}, {i.SQL_CENTERS}, p AS (SELECT v.label, s.id, list_inner_product(s.vec, s.vec) - 2 * list_inner_product(s.vec, c.vec) AS f, "
       "list_distance(s.vec, c.vec) ** 2 AS e FROM s JOIN v USING (id) JOIN c ON c.cid = v.label) "
       "SELECT id, round(f, 6) AS fast, round(e - f, 6) AS gap FROM p")
def fast_l2_order(spark, sf):
    stored = _paired(spark, sf).withColumn("sq", d.squared_norm("a"))
    fast = d.fast_l2("a", "b", "sq")
    return stored.select("id", i.r6(fast).alias("fast"), i.r6(d.l2sq("a", "b") - fast).alias("gap"))


@query("sql_distance_functions", PAIRED + "SELECT id, round(list_distance(a, b) ** 2, 6) AS l2, round(-list_inner_product(a, b), 6) AS ip, "
       "round(1 - list_cosine_similarity(a, b), 6) AS cosine, round(sqrt(list_inner_product(a, a)), 6) AS norm FROM p")
def sql_distance_functions(spark, sf):
    d.register_sql_functions(spark)
    return _paired(spark, sf).select(
        "id", *[i.r6(F.expr(e)).alias(n) for n, e in (
            ("l2", "l2sq(a, b)"), ("ip", "ip_dist(a, b)"), ("cosine", "cos_dist(a, b)"), ("norm", "vec_norm(a)"))])


@query("vector_norms", f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED} SELECT id, round(sqrt(list_inner_product(vec, vec)), 6) AS norm FROM s")
def vector_norms(spark, sf):
    return i.scaled(spark, sf).select("id", i.r6(d.vec_norm("vec")).alias("norm"))


CELLS = "SELECT id, generate_subscripts({e}, 1) - 1 AS pos, unnest({e}) AS x FROM {t}"


def _cells(df, col="vec", key="id"):
    return df.select(key, F.posexplode(col).alias("pos", "x")).select(
        F.col(key).alias("id"), F.col("pos").cast("long").alias("pos"), i.r6(F.col("x").cast("double")).alias("x"))


def _cells_sql(prefix, expr, t):
    return f"{prefix} SELECT id, pos, round(x, 6) AS x FROM (" + CELLS.format(e=expr, t=t) + ")"


BOTH = f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED}"


@query("normalize_rows", _cells_sql(BOTH + ", n AS (SELECT id, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS vec FROM s)", "vec", "n"))
def normalize_rows(spark, sf):
    return _cells(transforms.normalize_rows(i.scaled(spark, sf)))


@query("mips_base", _cells_sql(
    BOTH + ", m AS (SELECT sqrt(max(list_inner_product(vec, vec))) AS mx FROM s), n AS (SELECT id, list_append(list_transform(vec, lambda x: x / mx), "
    "sqrt(greatest(0, 1 - list_inner_product(vec, vec) / (mx * mx)))) AS vec FROM s, m)", "vec", "n"))
def mips_base(spark, sf):
    # The appended element is the root of a difference near zero for the longest rows, so it is
    # rounded to 6 digits only after clearing rounding noise below 1e-12.
    df = transforms.mips_to_l2_base(i.scaled(spark, sf))
    return _cells(df)


@query("mips_query", _cells_sql(
    BOTH + ", n AS (SELECT id, list_append(list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))), 0) AS vec FROM s)", "vec", "n"))
def mips_query(spark, sf):
    df = i.scaled(spark, sf).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return _cells(transforms.mips_to_l2_query(df), "qvec", "qid")


@query("mips_restore", f"WITH {i.SQL_VECTORS}, {i.SQL_SCALED}, p AS (SELECT q.id AS qid, b.id, list_inner_product(q.vec, b.vec) AS score FROM v q JOIN s b ON q.id <> b.id) "
       "SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM p) WHERE r <= 5")
def mips_restore(spark, sf):
    """Search in lifted L2 space, then report true inner products."""
    from vecloom.operators.knn import exact_knn
    base, queries = i.scaled(spark, sf), i.all_queries(spark, sf)
    found = exact_knn(transforms.mips_to_l2_base(base).drop("max_norm"), transforms.mips_to_l2_query(queries), 5, skip_same=True)
    return transforms.mips_restore(found, base, queries).select("qid", "id", i.r6("score").alias("score"))


@query("sq_encode", f"{BOTH}, n AS (SELECT id, list_transform(vec, lambda x: trunc(least(greatest((x - 0.01) * 254 / 4, -128), 127))::BIGINT) AS vec FROM s) "
       + CELLS.format(e="vec", t="n"))
def sq_encode(spark, sf):
    df = i.scaled(spark, sf).withColumn("vec", transforms.sq_encode("vec", 0.01, 4.0))
    return df.select("id", F.posexplode("vec").alias("pos", "x")).select(
        "id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("long").alias("x"))


@query("sq_decode", _cells_sql(
    f"WITH {i.SQL_VECTORS}, n AS (SELECT id, list_transform(vec, lambda x: (round(x * 127) - 0.5) * 0.03125) AS vec FROM v)", "vec", "n"))
def sq_decode(spark, sf):
    df = i.int8_vectors(spark, sf).withColumn("vec", transforms.sq_decode("vec", 0.5, 0.03125))
    return _cells(df)


@query("cast_uint8", f"{BOTH}, n AS (SELECT id, list_transform(vec, lambda x: trunc(least(greatest(x * 300, 0), 255))::BIGINT) AS vec FROM s) "
       + CELLS.format(e="vec", t="n"))
def cast_uint8(spark, sf):
    df = i.scaled(spark, sf).withColumn("vec", F.transform("vec", lambda x: x * 300))
    return transforms.cast_vec(df, "uint8").select("id", F.posexplode("vec").alias("pos", "x")).select(
        "id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("long").alias("x"))


@query("residuals", _cells_sql(
    f"WITH {i.SQL_VECTORS}, {i.SQL_CENTERS}, a AS (SELECT id, v.vec, c.vec AS cv, row_number() OVER (PARTITION BY id ORDER BY list_distance(v.vec, c.vec), cid) AS r FROM v, c), "
    "n AS (SELECT id, list_transform(list_zip(vec, cv), lambda z: z[1] - z[2]) AS vec FROM a WHERE r = 1)", "vec", "n"))
def residuals(spark, sf):
    base, centers = i.vectors(spark, sf), i.class_centers(spark, sf)
    near = assign_centers(base, centers, 1).select("id", "cid")
    return _cells(transforms.residuals(base.join(near, "id"), centers))


@query("residuals_round_trip", _cells_sql(f"WITH {i.SQL_VECTORS}", "vec", "v"))
def residuals_round_trip(spark, sf):
    base, centers = i.vectors(spark, sf), i.class_centers(spark, sf)
    near = base.join(assign_centers(base, centers, 1).select("id", "cid"), "id")
    return _cells(transforms.residuals(transforms.residuals(near, centers), centers, add=True))


@query("halfprec_report", "WITH e AS (SELECT unnest(embedding) AS x FROM embeddings) SELECT count(*) AS n, 0::BIGINT AS f16_overflow, 0::BIGINT AS bf16_overflow, "
       "true AS f16_close, true AS bf16_close, true AS f16_nearer_more_often FROM e")
def halfprec_report(spark, sf):
    r = precision.halfprec_report(i.vectors(spark, sf))
    return r.select(
        "n", "f16_overflow", "bf16_overflow", (F.col("f16_max_error") < 2**-11).alias("f16_close"),
        (F.col("bf16_max_error") < 2**-8).alias("bf16_close"), (F.col("f16_wins") > F.col("bf16_wins")).alias("f16_nearer_more_often"))


@query("validate_vectors", "SELECT count(*) AS n_rows, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, 0::BIGINT AS null_vectors, "
       "0::BIGINT AS bad_ids, count(*) - count(DISTINCT vec_id) AS repeated_ids FROM embeddings")
def validate_vectors(spark, sf):
    return validate.vector_report(validate.validate_vectors(i.vectors(spark, sf), "l2"))
