"""Checks of vectors and arguments."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed metrics per element type.
ALLOWED = {
    "float": ("l2", "mips", "cosine"),
    "int8": ("l2", "cosine"),
    "uint8": ("l2", "cosine"),
}


def check_metric(dtype: str, metric: str) -> None:
    if dtype not in ALLOWED:
        raise ValueError(f"element type must be one of {sorted(ALLOWED)}, not {dtype!r}")
    if metric not in ALLOWED[dtype]:
        raise ValueError(f"metric {metric!r} is not available for {dtype}")


def check_positive(**values: int) -> None:
    for name, value in values.items():
        if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
            raise ValueError(f"{name} must be a positive integer, not {value!r}")


def list_size(k: int, L: int, bump: bool = False) -> int:
    """Search list size; smaller than k is an error, or raised to k with a warning."""
    check_positive(k=k, L=L)
    if L >= k:
        return L
    if not bump:
        raise ValueError(f"list size {L} must be at least k = {k}")
    warnings.warn(f"list size {L} raised to k = {k}", stacklevel=2)
    return k


def vector_report(df: DataFrame) -> DataFrame:
    """One row of counts over ``(id, vec)``: rows, dims, nulls, negative and repeated ids."""
    repeated = df.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    report = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("vec")).cast("long").alias("min_dim"),
        F.max(F.size("vec")).cast("long").alias("max_dim"),
        F.count_if(F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull())).alias("null_vectors"),
        F.count_if(F.col("id").isNull() | (F.col("id") < 0)).alias("bad_ids"),
    )
    return report.crossJoin(F.broadcast(repeated.agg(F.count(F.lit(1)).alias("repeated_ids"))))  # one row each


def validate_vectors(df: DataFrame, metric: str, dtype: str = "float", k: int = 1, L: int = 1) -> DataFrame:
    """Raise ValueError unless ``df`` is a usable vector set; returns ``df``."""
    check_metric(dtype, metric)
    list_size(k, L)
    r = vector_report(df).first()
    problems = []
    if r.n_rows == 0:
        problems.append("no rows")
    if r.null_vectors:
        problems.append(f"{r.null_vectors} vectors with nulls")
    if r.n_rows and r.min_dim != r.max_dim:
        problems.append(f"dimensions from {r.min_dim} to {r.max_dim}")
    if r.bad_ids:
        problems.append(f"{r.bad_ids} missing or negative ids")
    if r.repeated_ids:
        problems.append(f"{r.repeated_ids} repeated ids")
    if problems:
        raise ValueError("bad vectors: " + "; ".join(problems))
    return df
