"""Generated vectors and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distances import vec_norm
from ..functions.transforms import clamp_cast
from ..plans.scratch import stored

ZIPF_FACTOR = 0.7  # fixed value: P(label i) = 0.7 / i


def gen_vectors(
    spark: SparkSession, n: int, dim: int, dtype: str = "float", norm: float | None = None, scale: float = 1.0, seed: int = 0,
) -> DataFrame:
    """n rows of N(0, 1) values; a fixed ``norm``, a random factor in [1, scale] per row, or rounded
    int8 / uint8 (shifted by 128) around the norm."""
    if dtype not in ("float", "int8", "uint8"):
        raise ValueError(f"unknown element type {dtype!r}")
    if dtype != "float" and not norm:
        raise ValueError("integer vectors need a norm")
    cells = [F.randn(seed * 100_003 + d) for d in range(dim)]
    rows = spark.range(n).select("id", F.array(*cells).alias("vec"))
    if scale > 1.0 and dtype == "float":
        rows = rows.withColumn("_f", 1.0 + F.rand(seed + 7) * (scale - 1.0))
        rows = rows.withColumn("vec", F.transform("vec", lambda x: x * F.col("_f"))).drop("_f")
    if norm:
        rows = rows.withColumn("_n", vec_norm("vec"))
        rows = rows.withColumn("vec", F.transform("vec", lambda x: x * F.lit(float(norm)) / F.col("_n"))).drop("_n")
    if dtype == "float":
        return rows.withColumn("vec", F.col("vec").cast("array<float>"))
    shift = 128.0 if dtype == "uint8" else 0.0
    return rows.withColumn("vec", F.transform("vec", lambda x: clamp_cast(F.round(x) + F.lit(shift), dtype)))


def gen_labels(spark: SparkSession, n: int, n_labels: int, dist: str = "zipf", seed: int = 0) -> DataFrame:
    """``(id, labels)`` with labels as text; a point without any gets label 0.

    ``zipf``: label i with probability 0.7 / i, and at most that share of the points; ``random``:
    each label with 50 %; ``one_per_point``: one of 0..n_labels.
    """
    points = spark.range(n)
    if dist == "one_per_point":
        drawn = F.floor(F.rand(seed) * (n_labels + 1)).cast("string")
        return points.select("id", F.array(drawn).alias("labels"))
    if dist not in ("zipf", "random"):
        raise ValueError(f"unknown distribution {dist!r}")
    pairs = points.select("id", F.explode(F.sequence(F.lit(1), F.lit(n_labels))).alias("label"))
    if dist == "random":
        kept = pairs.where(F.rand(seed) < 0.5)
    else:
        # A label's points come at random, so its first floor(share) of them are those with the
        # smallest ids; they are counted by id range, then inside the range the cap falls into.
        drawn = pairs.withColumn("_u", F.rand(seed)).where(F.col("_u") < F.lit(ZIPF_FACTOR) / F.col("label")).drop("_u")
        cap = F.greatest(F.lit(1), F.floor(F.lit(ZIPF_FACTOR * n) / F.col("label")))
        block = F.floor(F.col("id") / 65_536)
        drawn = stored(drawn.withColumn("_b", block), "drawn")
        counts = drawn.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_c"))
        earlier = Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")
        inside = Window.partitionBy("label", "_b").orderBy("id")
        kept = (
            drawn.withColumn("_r", F.row_number().over(inside)).join(counts, ["label", "_b"])
            .where(F.col("_before") + F.col("_r") <= cap).select("id", "label")
        )
    labels = kept.groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    some = F.transform("labels", lambda x: x.cast("string"))
    return points.join(labels, "id", "left").select("id", F.coalesce(some, F.array(F.lit("0"))).alias("labels"))
