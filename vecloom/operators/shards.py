"""Sampling, clustering and sharding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import DEFAULTS
from ..functions.distances import vec_norm
from ..functions.hashing import seeded_order
from ..functions.transforms import normalized
from ..plans.arrays import Block, longs, matrix
from ..plans.blocks import BROADCAST_BYTES, cell_pairs, nearest_of_small
from ..plans.numbering import number_rows
from ..plans.scratch import compute_partitions, fetch_bounded, small_or_same, stored
from ..plans.sums import add_rows, group_sums, vector_means
from .knn import exact_knn, rank_results

MAX_SMALL_CENTERS = 65_536
IVF_SALTS = 8  # tasks that may share the rows of one shard while it is written


def sample_vectors(df: DataFrame, rate: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Repeatable row sample: a row stays when its seeded hash is below ``rate`` (capped at 1)."""
    rate = min(1.0, rate)
    if rate >= 1.0:
        return df
    limit = format(int(rate * 2**32), "08x")
    return df.where(F.substring(seeded_order(seed, id_col), 1, 8) < F.lit(limit))


def small_centers(centers: DataFrame):
    """Ids and matrix of a centre set that is small enough to be sent everywhere, else None."""
    table = fetch_bounded(centers.select(F.col("cid").cast("long").alias("cid"), "vec"), MAX_SMALL_CENTERS)
    if table is None or table.num_rows == 0:
        return None
    rows = matrix(table.column("vec"))
    return (longs(table.column("cid")), rows) if rows.nbytes <= BROADCAST_BYTES else None


def assign_centers(
    df: DataFrame, centers: DataFrame, k: int = 1, metric: str = "l2", id_col: str = "id", vec_col: str = "vec",
) -> DataFrame:
    """``(id, cid, rank, dist)``: the k nearest centres of each row.

    A small centre set goes to every task and nothing is shuffled; a large one is joined in cells.
    """
    sent = small_centers(centers)
    if sent is not None:
        return nearest_of_small(df, sent, metric, k, id_col, vec_col, [id_col])
    base = centers.select(F.col("cid").cast("long").alias("id"), "vec")
    points = df.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("qvec"))
    found = rank_results(cell_pairs(base, points, metric, k=k), k)
    return found.select(F.col("qid").alias(id_col), F.col("id").alias("cid"), "rank", "dist")


def inverted_lists(assigned: DataFrame) -> DataFrame:
    """``(cid, pos, id)``: members of each centre in id order, one row each, so a hot centre stays spread."""
    rows = number_rows(assigned.select("cid", "id"), ["cid", "id"], "_at")
    first = small_or_same(rows.groupBy("cid").agg(F.min("_at").alias("_first")))
    return rows.join(first, "cid").select("cid", (F.col("_at") - F.col("_first")).alias("pos"), "id")


def kmeans(df: DataFrame, k: int, reps: int = 10, seed: int = 1, init: str = "k-means||") -> DataFrame:
    """``(cid, vec)``: k-means centres by Lloyd iterations from seeded k-means|| (or ``random``) starts."""
    train = df.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=reps, seed=seed, tol=1e-5, initMode=init).fit(train)
    rows = [(n, [float(x) for x in c]) for n, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cid long, vec array<double>")


def lloyd_step(df: DataFrame, centers: DataFrame) -> DataFrame:
    """One Lloyd step: ``(cid, vec, n, residual)`` with the mean of the rows nearest each centre.

    Rows are assigned and added up inside each Arrow batch; only sums per centre are shuffled.
    A centre without rows is left out.
    """
    sent = small_centers(centers)
    if sent is None:
        near = assign_centers(df, centers, 1).select("id", "cid", "dist")
        joined = df.select("id", "vec").join(near, "id")
        means = vector_means(joined, "cid")
        return means.join(joined.groupBy("cid").agg(F.sum("dist").alias("residual")), "cid")
    held = df.sparkSession.sparkContext.broadcast(sent)

    def partial(table: pa.Table):
        ids, centers_ = held.value
        block = Block(ids, centers_, "l2")
        rows = matrix(table.column("vec"))
        _, at, d = block.nearest(np.arange(len(rows)), rows, 1)
        used, at = np.unique(at, return_inverse=True)
        wide = np.hstack([rows, np.ones((len(rows), 1)), d[:, None]])
        return pa.array(block.ids[used], pa.int64()), add_rows(at, len(used), wide)

    sums = group_sums(df.select("vec"), T.LongType(), "cid", partial)
    n = F.element_at("sums", -2)
    return sums.select(
        "cid",
        F.transform(F.slice("sums", 1, F.size("sums") - 2), lambda x: x / n).alias("vec"),
        n.cast("long").alias("n"),
        F.element_at("sums", -1).alias("residual"),
    )


def lloyd(df: DataFrame, centers: DataFrame, reps: int, gain: float = 1e-5) -> tuple[DataFrame, float]:
    """Lloyd steps from given centres until the relative residual gain falls below ``gain``.

    A centre that loses all its rows keeps its place.
    """
    last = None
    for _ in range(reps):
        step = stored(lloyd_step(df, centers), "lloyd")
        residual = step.agg(F.sum("residual")).first()[0]
        old = centers.select("cid", F.col("vec").cast("array<double>").alias("_old"))
        centers = stored(
            old.join(step.select("cid", "vec"), "cid", "left").select("cid", F.coalesce("vec", "_old").alias("vec")),
            "centers",
        )
        if last is not None and (last == 0 or (last - residual) / last < gain):
            break
        last = residual
    return centers, residual


def shard_points(df: DataFrame, centers: DataFrame, k_base: int = DEFAULTS["k_base"]) -> DataFrame:
    """``(id, shard, rank)``: overlapping shards, each row in those of its ``k_base`` nearest centres."""
    return assign_centers(df, centers, k_base).select("id", F.col("cid").alias("shard"), "rank")


def shard_vectors(df: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Rows of each shard: ``(shard, id, vec, ...)``."""
    return shard_map.select("id", "shard").join(df, "id")


def estimate_shards(sample: DataFrame, centers: DataFrame, k_base: int, rate: float) -> DataFrame:
    """``(shard, estimate)``: rows per shard of the full set, from a sample taken at ``rate``."""
    counts = shard_points(sample, centers, k_base).groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("shard", F.floor(F.col("_n") / F.lit(rate)).cast("long").alias("estimate"))


def shard_bytes(rows: int, dim: int, degree: int, width: int = 4) -> float:
    """Memory of one shard while its graph is built."""
    padded = -(-dim // 8) * 8
    return 1.1 * rows * (padded * width + degree * 4 * DEFAULTS["slack"] + 8)


def partition_with_budget(
    df: DataFrame, budget_bytes: float, degree: int, k_base: int = DEFAULTS["k_base"], rate: float = 0.1,
    seed: int = 1, max_parts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Centres and shard estimates for the fewest shards (3, 5, 7, ...) whose largest fits the budget.

    An error if even one shard per sampled row, or ``max_parts`` shards where the caller sets a limit, do not fit.
    """
    sample = stored(sample_vectors(df, rate, seed), "sample")
    n = sample.count()
    if n == 0:
        raise ValueError("the sample is empty; raise the rate")
    dim = len(sample.select("vec").first()[0])
    parts = DEFAULTS["partition_start"]
    while True:
        centers = kmeans(sample, min(parts, n), DEFAULTS["partition_reps"], seed)
        estimate = stored(estimate_shards(sample, centers, k_base, rate), "estimate")
        largest = estimate.agg(F.max("estimate")).first()[0]
        if shard_bytes(largest, dim, degree) <= budget_bytes:
            return centers, estimate
        if parts >= (n if max_parts is None else min(n, max_parts)):
            raise ValueError(f"{min(parts, n)} shards do not fit {budget_bytes} bytes; raise the budget, the rate or max_parts")
        parts += 2


def split_to_budget(
    df: DataFrame, budget_bytes: float, degree: int, k_base: int = DEFAULTS["k_base"], rate: float = 0.1, seed: int = 1,
    reps: int = 4,
) -> tuple[DataFrame, DataFrame, int]:
    """Centres, shard estimates, and the number of rounds, for shards that all fit the budget.

    Starts from a few k-means centres. In each round every shard that is too large gives its centre up for as many of its
    rows, drawn by a seeded hash, as it needs and one more; all are assigned in one pass. Rows stay centres as they are: means
    of few rows lie near everything, and as second choice would fill up again. An error if a shard of equal rows
    does not fit.
    """
    sample = stored(sample_vectors(df, rate, seed).select("id", F.col("vec").cast("array<double>").alias("vec")), "sample")
    n = sample.count()
    if n == 0:
        raise ValueError("the sample is empty; raise the rate")
    dim = len(sample.select("vec").first()[0])
    centers, fits = stored(kmeans(sample, min(DEFAULTS["partition_start"], n), reps, seed), "centers"), 1
    while True:
        estimate = stored(estimate_shards(sample, centers, k_base, rate), "estimate")
        most = _rows_within(budget_bytes, dim, degree)
        over = stored(estimate.where(F.col("estimate") > most).select(
            F.col("shard").alias("cid"), (F.ceil(F.col("estimate") / max(1, most)) + 1).alias("_parts")), "over")
        if over.isEmpty():
            return centers, estimate, fits
        near = shard_points(sample, centers, k_base).select("id", F.col("shard").alias("cid")).join(over, "cid")
        order = Window.partitionBy("cid").orderBy("_h", "id")
        drawn = stored(
            near.join(sample, "id").groupBy("cid", "_parts", "vec").agg(F.min("id").alias("id"))
            .withColumn("_h", seeded_order(seed + fits, "id")).withColumn("_n", F.row_number().over(order))
            .where(F.col("_n") <= F.col("_parts")).select("cid", "vec"), "drawn")
        several = drawn.groupBy("cid").count().where("count > 1").select("cid")
        if several.isEmpty():
            raise ValueError(f"shards of equal rows do not fit {budget_bytes} bytes; raise the budget")
        fresh = drawn.join(several, "cid", "left_semi")
        kept = centers.join(several, "cid", "left_anti").select("vec").unionByName(fresh.select("vec"))
        renumbered = number_rows(kept, ["vec"], "cid").select(F.col("cid").cast("long").alias("cid"), "vec")
        centers = stored(renumbered, "centers")
        fits += 1


def _rows_within(budget_bytes: float, dim: int, degree: int) -> int:
    """The most rows whose shard fits the budget."""
    return int(budget_bytes / shard_bytes(1, dim, degree))


def cluster_order(df: DataFrame, centers: DataFrame) -> DataFrame:
    """``(pos, cid, id)``: rows laid out cluster by cluster."""
    near = assign_centers(df, centers, 1).select("cid", "id")
    return number_rows(near, ["cid", "id"], "pos").select("pos", "cid", "id")


def cluster_offsets(layout: DataFrame) -> DataFrame:
    """``(cid, first, n)``: where each cluster of a :func:`cluster_order` layout begins."""
    return layout.groupBy("cid").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))


def medoid(df: DataFrame) -> DataFrame:
    """``(id, dist)``: the row nearest the mean of all rows."""
    mean = vector_means(df.select("vec", F.lit(0).cast("long").alias("qid")), "qid", out="qvec")
    return exact_knn(df, mean, 1).select("id", "dist")


def random_sphere_points(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``(id, vec)``: n random points with the mean norm of the rows, numbered from -1 downwards."""
    shape = df.agg(F.avg(vec_norm("vec")).alias("norm"), F.max(F.size("vec")).alias("dim"))  # one row
    raw = (
        df.sparkSession.range(n).crossJoin(F.broadcast(shape))
        .select((-F.col("id") - 1).alias("id"), "norm", F.explode(F.sequence(F.lit(1), F.col("dim"))).alias("pos"))
        .withColumn("x", F.randn(seed))
        .groupBy("id", "norm").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("cells"))
        .select("id", "norm", F.transform("cells", lambda c: c["x"]).alias("vec"))
    )
    return raw.withColumn("_unit", normalized("vec")).select(
        "id", F.transform("_unit", lambda x: x * F.col("norm")).alias("vec"))


def route_queries(queries: DataFrame, centers: DataFrame, nprobe: int, metric: str = "l2") -> DataFrame:
    """``(qid, shard, rank, dist)``: the nprobe shards nearest each query."""
    found = assign_centers(queries, centers, nprobe, metric, "qid", "qvec")
    return found.withColumnRenamed("cid", "shard")


def write_ivf(df: DataFrame, centers: DataFrame, path: str, k_base: int = 1) -> None:
    """Rows ``(id, vec)`` in a folder per shard, each row in those of its ``k_base`` nearest centres.

    A small centre set goes to the rows, which are assigned where they are read and shuffled once, with their vectors.
    A shard with very many rows is written by several tasks.
    """
    spark = df.sparkSession
    rows = df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    sent = small_centers(centers)
    if sent is not None:
        placed = nearest_of_small(rows, sent, "l2", k_base, "id", "vec", ["id", "vec"], out_id="shard")
    else:
        placed = assign_centers(rows, centers, k_base).select("id", F.col("cid").alias("shard")).join(rows, "id")
    salted = placed.select("shard", "id", "vec").withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(IVF_SALTS)))
    salted.repartition(compute_partitions(spark) * 4, "shard", "_salt").drop("_salt").write.mode("overwrite").partitionBy(
        "shard").parquet(path)


def read_ivf(spark, path: str, routed: DataFrame | None = None) -> DataFrame:
    """``(shard, id, vec)`` of the layout, or only of the shards in ``routed(shard)``: other shards' files are not opened.

    There are at most as many shards as centres, so the wanted ones are a list in the scan's partition filter.
    """
    rows = spark.read.schema("id long, vec array<double>, shard long").parquet(path)
    if routed is None:
        return rows
    return rows.where(F.col("shard").isin([r.shard for r in routed.select("shard").distinct().collect()]))


def ivf_search_pruned(
    path: str, centers: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str = "l2", skip_same: bool = False,
) -> DataFrame:
    """As :func:`ivf_search` over a layout of :func:`write_ivf`; reads the shards that some query visits."""
    routed = stored(route_queries(queries, centers, nprobe, metric).select("qid", "shard"), "routed")
    held = read_ivf(queries.sparkSession, path, routed)
    return _search_routed(held, routed, queries, k, metric, skip_same)


def ivf_search(
    shards: DataFrame, centers: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str = "l2",
    skip_same: bool = False,
) -> DataFrame:
    """k nearest rows among the nprobe nearest shards of each query; ``shards(shard, id, vec)``.

    Exact inside the visited shards. A row held by several visited shards counts once.
    """
    return _search_routed(
        shards, route_queries(queries, centers, nprobe, metric).select("qid", "shard"), queries, k, metric, skip_same)


def _search_routed(shards: DataFrame, routed: DataFrame, queries: DataFrame, k: int, metric: str, skip_same: bool) -> DataFrame:
    asked = routed.join(queries, "qid").select("shard", "qid", "qvec")
    pairs = cell_pairs(shards.select("shard", "id", "vec"), asked, metric, k=k, by="shard", skip_same=skip_same)
    return rank_results(pairs.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k)
