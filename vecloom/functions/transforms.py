"""Column transforms of vectors: normalising, inner-product lifting, scalar quantising, casts, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distances import ip_dist, squared_norm, vec_norm

FLOAT_EPS = 1.1920929e-07  # fixed value: smallest float32 step at 1

# Range of each element type.
RANGES = {"int8": (-128, 127), "uint8": (0, 255), "uint32": (0, 4294967295)}
SPARK_TYPES = {"int8": "tinyint", "uint8": "smallint", "uint32": "bigint", "float": "float", "double": "double"}


def normalized(vec: Column | str) -> Column:
    """Vector divided by max(norm, eps)."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    by = F.greatest(vec_norm(vec), F.lit(FLOAT_EPS))
    return F.transform(vec, lambda x: x.cast("double") / by)


def normalize_rows(df: DataFrame, col: str = "vec") -> DataFrame:
    return df.withColumn(col, normalized(col))


def max_norm(df: DataFrame, col: str = "vec") -> DataFrame:
    """One row: the largest norm ``max_norm``."""
    return df.agg(F.sqrt(F.max(squared_norm(col))).alias("max_norm"))


def mips_to_l2_base(df: DataFrame, col: str = "vec") -> DataFrame:
    """Divide by the largest norm M and append sqrt(1 - |x|^2 / M^2); M is kept as ``max_norm``.

    L2 order on the result is inner-product order on the input.
    """
    lifted = df.crossJoin(F.broadcast(max_norm(df, col)))  # one row
    scaled = F.transform(F.col(col), lambda x: x.cast("double") / F.col("max_norm"))
    rest = F.sqrt(F.greatest(F.lit(0.0), 1.0 - squared_norm(col) / (F.col("max_norm") * F.col("max_norm"))))
    return lifted.withColumn(col, F.concat(scaled, F.array(rest)))


def mips_to_l2_query(df: DataFrame, col: str = "qvec") -> DataFrame:
    """Unit norm, and a zero appended."""
    return df.withColumn(col, F.concat(normalized(col), F.array(F.lit(0.0))))


def mips_restore(results: DataFrame, base: DataFrame, queries: DataFrame) -> DataFrame:
    """Replace the lifted L2 distance by the true inner product ``score`` of the original vectors."""
    return (
        results.join(base.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
        .withColumn("score", -ip_dist("vec", "qvec")).drop("vec", "qvec")
    )


def lifted_to_score(dist: Column | str, max_norm_: Column | str, query_norm: Column | str) -> Column:
    """True inner product from the lifted distance: (1 - d / 2) * M * |q|."""
    dist, max_norm_, query_norm = (F.col(c) if isinstance(c, str) else c for c in (dist, max_norm_, query_norm))
    return (F.lit(1.0) - dist / 2.0) * max_norm_ * query_norm


def clamp_cast(x: Column, dtype: str) -> Column:
    """Cast one element, clamped to the range of the type and cut toward zero."""
    if dtype in RANGES:
        low, high = RANGES[dtype]
        return F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(float(high))).cast(SPARK_TYPES[dtype])
    return x.cast(SPARK_TYPES[dtype])


def sq_encode(vec: Column | str, bias: float, scale: float) -> Column:
    """float -> int8 by (x - bias) * 254 / scale, clamped."""
    return F.transform(
        vec, lambda x: clamp_cast((x.cast("double") - F.lit(bias)) * F.lit(254.0) / F.lit(scale), "int8"))


def sq_decode(vec: Column | str, bias: float, scale: float) -> Column:
    """int8 -> float by (x - bias) * scale."""
    return F.transform(vec, lambda x: (x.cast("double") - F.lit(bias)) * F.lit(scale))


def cast_vec(df: DataFrame, to: str, col: str = "vec") -> DataFrame:
    """Change the element type (int8, uint8, uint32, float, double), clamping integers."""
    return df.withColumn(col, F.transform(F.col(col), lambda x: clamp_cast(x, to)))


def residuals(assigned: DataFrame, centroids: DataFrame, add: bool = False) -> DataFrame:
    """Subtract (or add back) the centroid of each row of ``assigned(id, vec, cid)``."""
    sign = 1.0 if add else -1.0
    center = centroids.select("cid", F.col("vec").alias("_center"))
    return (
        assigned.join(center, "cid")
        .withColumn("vec", F.zip_with("vec", "_center", lambda x, c: x.cast("double") + F.lit(sign) * c))
        .drop("_center")
    )
