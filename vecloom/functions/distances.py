"""Distances as Column functions on array columns, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("l2", "mips", "cosine", "fast_l2")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(a: Column | str) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def vec_norm(a: Column | str) -> Column:
    return F.sqrt(squared_norm(a))


def l2sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x * x)


def ip_dist(a: Column | str, b: Column | str) -> Column:
    """Negated dot product, so that smaller is nearer."""
    return -dot(a, b)


def cos_dist(a: Column | str, b: Column | str) -> Column:
    """1 - cosine similarity; NULL when a norm is zero."""
    norms = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.when(norms > 0, F.lit(1.0) - dot(a, b) / norms)


def cos_dist_unit(a: Column | str, b: Column | str) -> Column:
    """Cosine distance of vectors that already have norm 1."""
    return F.lit(1.0) - dot(a, b)


def fast_l2(base: Column | str, query: Column | str, base_sq_norm: Column | str) -> Column:
    """|x|^2 - 2 x.q with a stored |x|^2: orders like squared L2 for one query."""
    return _col(base_sq_norm) - F.lit(2.0) * dot(base, query)


def distance(metric, a: Column | str, b: Column | str) -> Column:
    """Distance by metric name, ``a`` being the base vector; a callable of two columns is used as it is."""
    if callable(metric):
        return metric(_col(a), _col(b))
    if metric == "fast_l2":
        return fast_l2(a, b, squared_norm(a))
    return {"l2": l2sq, "mips": ip_dist, "cosine": cos_dist}[metric](a, b)


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions vec_dot, l2sq, ip_dist, cos_dist, vec_norm."""
    arrays = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    bodies = {
        f"vec_dot({arrays})": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
        f"l2sq({arrays})": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
        f"ip_dist({arrays})": "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
        f"cos_dist({arrays})": (
            "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
            "nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"
        ),
        "vec_norm(a ARRAY<DOUBLE>)": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
