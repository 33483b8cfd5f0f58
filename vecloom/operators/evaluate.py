"""Recall, ranges, percentiles and sweep reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import vec_norm
from ..plans.numbering import running_total
from ..plans.scratch import stored


def _truth_with_ties(truth: DataFrame, r: int) -> DataFrame:
    """First r truth rows per query, and those further ones at the same distance as the r-th."""
    edge = truth.where(F.col("rank") <= r).groupBy("qid").agg(F.max("dist").alias("_edge"))
    return truth.join(edge, "qid").where((F.col("rank") <= r) | (F.col("dist") == F.col("_edge"))).select("qid", "id")


def recall(
    results: DataFrame, truth: DataFrame, r: int, ties: bool = True, active: DataFrame | None = None,
) -> DataFrame:
    """One row: ``recall`` at r in percent over the truth's queries, ``n_queries``, ``short_queries``.

    ``active(id)`` keeps only live ids in the truth. ``short_queries`` counts queries whose truth
    then has fewer than r rows (their recall is under-reported). The truth is read several times, so it is stored first.
    """
    truth = stored(truth, "truth")
    if active is not None:
        order = Window.partitionBy("qid").orderBy("dist", "id")
        truth = truth.join(active.select("id"), "id", "left_semi").withColumn("rank", F.row_number().over(order))
    wanted = _truth_with_ties(truth, r) if ties else truth.where(F.col("rank") <= r).select("qid", "id")
    hits = (
        results.where(F.col("rank") <= r).select("qid", "id").distinct()
        .join(wanted.distinct(), ["qid", "id"], "left_semi")
        .groupBy("qid").agg(F.count(F.lit(1)).alias("_hits"))
    )
    sizes = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("_size"))
    return sizes.join(hits, "qid", "left").agg(
        (F.sum(F.coalesce("_hits", F.lit(0))) * 100.0 / (F.count(F.lit(1)) * r)).alias("recall"),
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(F.col("_size") < r).alias("short_queries"),
    )


def recall_curve(results: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """``(cut, recall)`` for every cut 1..r, in one pass over the joined lists.

    A result at rank a matches the truth at cut c when a <= c and its truth rank - counted with
    ties from the first row at its distance - is <= c.
    """
    truth = stored(truth, "truth")
    tie = Window.partitionBy("qid", "dist")
    entered = truth.withColumn("_t", F.min("rank").over(tie)).groupBy("qid", "id").agg(F.min("_t").alias("_t"))
    matched = (
        results.where(F.col("rank") <= r).join(entered, ["qid", "id"])
        .select(F.greatest("rank", "_t").alias("_from")).where(F.col("_from") <= r)
        .groupBy("_from").agg(F.count(F.lit(1)).alias("_n"))
    )
    n_queries = truth.agg(F.count_distinct("qid").alias("_nq"))  # one row
    cuts = truth.sparkSession.range(1, r + 1).select(F.col("id").cast("int").alias("cut"))
    per_cut = cuts.join(F.broadcast(matched), F.col("_from") <= F.col("cut"), "left")  # at most r rows each
    return (
        per_cut.groupBy("cut").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_hits"))
        .crossJoin(F.broadcast(n_queries))
        .select("cut", (F.col("_hits") * 100.0 / (F.col("_nq") * F.col("cut"))).alias("recall"))
    )


def range_recall(results: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: mean of the per-query recall in percent; a query without truth counts 100."""
    # Both sides meet in one shuffle by query; nothing is joined or made twice.
    both = truth.select("qid", "id", F.lit(1).alias("_t"), F.lit(0).alias("_r")).unionByName(
        results.select("qid", "id", F.lit(0).alias("_t"), F.lit(1).alias("_r")))
    pairs = both.repartition("qid").groupBy("qid", "id").agg(F.max("_t").alias("_t"), F.max("_r").alias("_r"))
    sizes = pairs.groupBy("qid").agg(
        F.sum("_t").alias("_truth"), F.sum(F.when(F.col("id").isNotNull(), F.col("_t") * F.col("_r")).otherwise(0)).alias("_hits"))
    per_query = queries.select("qid").join(sizes, "qid", "left").select(
        F.when(F.coalesce("_truth", F.lit(0)) == 0, 100.0)
        .otherwise(100.0 * F.col("_hits") / F.col("_truth")).alias("_recall"))
    return per_query.agg(F.avg("_recall").alias("range_recall"), F.count(F.lit(1)).alias("n_queries"))


def range_ratio(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: rows returned / rows in the truth."""
    returned = results.agg(F.count(F.lit(1)).alias("returned"))
    expected = truth.agg(F.count(F.lit(1)).alias("expected"))
    return returned.crossJoin(expected).withColumn(  # one row each
        "size_ratio", F.col("returned") / F.nullif(F.col("expected"), F.lit(0)))


def _ranked_values(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """``(fraction, value)`` with value = sorted[floor(fraction * n)], 1 being the last.

    Equal values are counted before the sort, so a value held by very many rows is one row.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = stored(running_total(counts, [value], "_n", "_before"), "ranked")
    n = ranked.agg(F.sum("_n")).first()[0] or 0
    marks = [(float(f), min(int(f * n + 1e-9), n - 1)) for f in fractions if n]
    marks = df.sparkSession.createDataFrame(marks, "fraction double, _pos long")
    holds = (F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_n"))
    return ranked.join(F.broadcast(marks), holds).select("fraction", value)  # a row per fraction is sent


def query_stats(stats: DataFrame, columns: list[str], fractions: list[float]) -> DataFrame:
    """``(stat, column, value)``: mean, and sorted[floor(p n)] for each p in ``fractions``; the rows are made once."""
    out, stats = None, stored(stats, "stats")
    means = stats.agg(*[F.avg(c).alias(c) for c in columns])
    for c in columns:
        mean = means.select(F.lit("mean").alias("stat"), F.lit(c).alias("column"), F.col(c).alias("value"))
        picked = _ranked_values(stats.select(F.col(c).cast("double").alias("value")), "value", fractions)
        part = mean.unionByName(picked.select(
            F.format_string("p%.3f", "fraction").alias("stat"),
            F.lit(c).alias("column"), "value"))
        out = part if out is None else out.unionByName(part)
    return out


def norm_percentiles(df: DataFrame) -> DataFrame:
    """``(percent, norm)`` for 0, 5, ..., 100; 100 is the largest."""
    fractions = [i / 20 for i in range(21)]
    picked = _ranked_values(df.select(vec_norm("vec").alias("norm")), "norm", fractions)
    return picked.select(F.round(F.col("fraction") * 100).cast("int").alias("percent"), "norm")


def sweep_report(results: DataFrame, stats: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """``(L, n_queries, avg_cmps, avg_hops, recall)`` per list size of a sweep."""
    wanted = _truth_with_ties(stored(truth, "truth"), r).distinct()
    hits = (
        results.where(F.col("rank") <= r).select("L", "qid", "id").distinct()
        .join(wanted, ["qid", "id"], "left_semi").groupBy("L").agg(F.count(F.lit(1)).alias("_hits"))
    )
    per_list = stats.groupBy("L").agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("n_cmps").alias("avg_cmps"), F.avg("n_hops").alias("avg_hops"))
    return per_list.join(hits, "L", "left").select(
        "L", "n_queries", "avg_cmps", "avg_hops",
        (F.coalesce("_hits", F.lit(0)) * 100.0 / (F.col("n_queries") * r)).alias("recall"))


def gate(report: DataFrame, min_recall: float) -> DataFrame:
    """One row: the best recall of a sweep and whether it reaches ``min_recall``."""
    return report.agg(F.max("recall").alias("best_recall")).withColumn("passed", F.col("best_recall") >= min_recall)
