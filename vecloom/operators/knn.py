"""Exact nearest neighbours: plain, tagged, filtered by one label or by a label per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import Rows, cell_pairs, scan_pairs, small_queries, vec_rows


def rank_results(pairs: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, id, dist)`` with the k best per query in the order (distance, id)."""
    best = Window.partitionBy("qid").orderBy("dist", "id")
    return (
        pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("qid", "rank", "id", "dist")
    )


def merge_topk(results: list[DataFrame], k: int, distinct_ids: bool = False) -> DataFrame:
    """Merge result lists of parts or indexes; the number of the list is kept as ``partition``.

    With ``distinct_ids`` an id found in several lists is reported once, from its first list.
    """
    union = None
    for n, part in enumerate(results):
        part = part.select("qid", "id", "dist", F.lit(n).alias("partition"))
        union = part if union is None else union.unionByName(part)
    if distinct_ids:
        union = (
            union.groupBy("qid", "id").agg(F.min(F.struct("dist", "partition")).alias("_best"))
            .select("qid", "id", "_best.dist", "_best.partition")
        )
    best = Window.partitionBy("qid").orderBy("dist", "id", "partition")
    return (
        union.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("qid", "rank", "id", "dist", "partition")
    )


def nearest_pairs(
    base: DataFrame, queries: DataFrame, k: int, metric: str, skip_same: bool = False,
    rows: Rows = vec_rows, payload: str = "vec",
) -> DataFrame:
    """The k best pairs per query of each task or cell, before the final ranking."""
    base = base.select("id", payload)
    sent = small_queries(queries)
    if sent is not None:
        return scan_pairs(base, sent, metric, k=k, skip_same=skip_same, rows=rows)
    return cell_pairs(base, queries.select("qid", "qvec"), metric, k=k, skip_same=skip_same, rows=rows)


def exact_knn(
    base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", *, tags: DataFrame | None = None,
    label: str | None = None, universal: str | None = None, where: Column | None = None,
    skip_same: bool = False,
) -> DataFrame:
    """Exact k nearest base rows ``(id, vec[, labels])`` of each query ``(qid, qvec)``.

    ``tags(id, tag)`` hides rows without a tag or with the reserved tag 0 before ranking and adds
    ``tag``. ``label`` keeps rows that carry it (or the ``universal`` label). A small query set is
    sent to the base partitions; a larger one meets the base in hashed cells.
    """
    if where is not None:
        base = base.where(where)
    if label is not None:
        carries = F.array_contains("labels", label)
        if universal is not None:
            carries = carries | F.array_contains("labels", universal)
        base = base.where(carries)
    if tags is not None:
        shown = tags.where("tag <> 0")
        base = base.join(shown.select("id"), "id", "left_semi")
    found = rank_results(nearest_pairs(base, queries, k, metric, skip_same), k)
    if tags is not None:
        found = found.join(shown.select("id", "tag"), "id").select("qid", "rank", "id", "dist", "tag")
    return found


def exact_knn_by_label(
    base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", *, universal: str | None = None,
    skip_same: bool = False,
) -> DataFrame:
    """Exact k nearest rows among those that carry the query's own ``label``.

    Rows with the ``universal`` label match every query, so they are scored once for all queries
    instead of being copied to each label.
    """
    plain = base
    if universal is not None:
        everywhere = F.array_contains("labels", universal)
        plain = base.where(~everywhere)
    exploded = plain.select("id", "vec", F.explode(F.array_distinct("labels")).alias("label"))
    wanted = queries.select("label").distinct()
    exploded = exploded.join(wanted, "label", "left_semi")
    pairs = cell_pairs(exploded, queries.select("qid", "qvec", "label"), metric, k=k, by="label", skip_same=skip_same)
    if universal is not None:
        pairs = pairs.unionByName(nearest_pairs(base.where(everywhere), queries, k, metric, skip_same))
    return rank_results(pairs, k)
