"""Labels: dictionary, predicates, statistics, splitting, start points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_order
from ..plans.numbering import number_rows
from ..plans.scratch import fetch_bounded, small_or_same, stored

LABEL_SET = 10_000  # labels that one point may be given at once
START_CANDIDATES = 25  # fixed value: random candidates per label start


def point_labels(df: DataFrame, labels: str = "labels") -> DataFrame:
    """``(id, pos, label)``, one row per label of a point."""
    return df.select("id", F.posexplode(labels).alias("pos", "label"))


def label_dictionary(df: DataFrame, universal: str | None = None) -> DataFrame:
    """``(label, code)`` by first appearance in (id, position) order.

    The universal label has code 0; others count from 1, or from 2 when there is a universal label.
    """
    first = point_labels(df).groupBy("label").agg(F.min(F.struct("id", "pos")).alias("_first"))
    if universal is None:
        return number_rows(first, ["_first"], "code", start=1).select("label", "code")
    others = number_rows(first.where(F.col("label") != universal), ["_first"], "code", start=2)
    zero = df.sparkSession.createDataFrame([(universal, 0)], "label string, code long")
    return others.select("label", "code").unionByName(zero)


def encode_labels(df: DataFrame, universal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, codes)`` with codes in label order, and the dictionary."""
    dictionary = small_or_same(label_dictionary(df, universal))
    coded = point_labels(df).join(dictionary, "label")
    return _collect_in_order(coded, "code", "codes"), dictionary


def decode_labels(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(id, labels)`` from ``(id, codes)``."""
    exploded = coded.select("id", F.posexplode("codes").alias("pos", "code"))
    return _collect_in_order(exploded.join(small_or_same(dictionary), "code"), "label", "labels")


def _collect_in_order(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rebuild the array of each point (its own labels only, so a small group)."""
    return (
        df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("_cells"))
        .select("id", F.transform("_cells", lambda c: c[value]).alias(out))
    )


def default_labels(df: DataFrame, default: str = "default") -> DataFrame:
    """Points without labels get one default label."""
    bare = F.col("labels").isNull() | (F.size("labels") == 0)
    return df.withColumn("labels", F.when(bare, F.array(F.lit(default))).otherwise(F.col("labels")))


def label_counts(df: DataFrame) -> DataFrame:
    """``(label, n)``: points per label."""
    return point_labels(df).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def expand_universal(df: DataFrame, universal: str) -> DataFrame:
    """Points with the universal label get every other label of the set instead.

    The label set becomes one row, and part of each such point; a set of over LABEL_SET labels is an error.
    """
    others = point_labels(df).where(F.col("label") != universal).select("label").distinct()
    names = fetch_bounded(others, LABEL_SET)
    if names is None:
        raise ValueError(f"over {LABEL_SET} labels: search with the universal label instead of expanding it")
    every = df.sparkSession.createDataFrame([(sorted(names.column("label").to_pylist()),)], "_every array<string>")
    return (
        df.crossJoin(F.broadcast(every))
        .withColumn("labels", F.when(F.array_contains("labels", universal), F.col("_every")).otherwise(F.col("labels")))
        .drop("_every")
    )


def labels_match(point: Column | str, query: Column | str, universal: str | None = None, build: bool = False) -> Column:
    """Point and query share a label, or the point (while building: either side) is universal."""
    match = F.arrays_overlap(point, query)
    if universal is not None:
        match = match | F.array_contains(point, universal)
        if build:
            match = match | F.array_contains(query, universal)
    return match


def resolve_query_label(queries: DataFrame, dictionary: DataFrame, universal: str | None = None) -> DataFrame:
    """Adds ``code`` and ``status``: known, universal (unknown label, universal set) or unknown."""
    known = queries.join(small_or_same(dictionary.select("label", "code")), "label", "left")
    status = F.when(F.col("code").isNotNull(), "known").otherwise("unknown" if universal is None else "universal")
    code = F.col("code") if universal is None else F.coalesce("code", F.lit(0))
    return known.withColumn("status", status).withColumn("code", code)


def label_stats(df: DataFrame, density: int = 10) -> DataFrame:
    """``(stat, label, value)``: count percentiles every 5 %, the 3 most common labels, averages."""
    counts = stored(label_counts(df), "label-counts")
    steps = [round(0.05 * i, 2) for i in range(20)]
    ordered = number_rows(counts, ["n", "label"], "_pos")
    n_labels = ordered.count()
    marks = df.sparkSession.createDataFrame(
        [(f"p{round(100 * f):02d}", int(f * n_labels + 1e-9)) for f in steps]
        + [(f"top{i + 1}", n_labels - 1 - i) for i in range(min(3, n_labels))],
        "stat string, _pos long",
    )
    picked = ordered.join(F.broadcast(marks), "_pos").select("stat", "label", F.col("n").cast("double").alias("value"))
    points = df.select(F.coalesce(F.size("labels"), F.lit(0)).alias("_n")).agg(
        F.count(F.lit(1)).cast("double").alias("points"),
        F.avg(F.col("_n")).alias("labels_per_point"),
        F.avg((F.col("_n") >= density).cast("double")).alias("dense_fraction"),
    )
    sizes = counts.agg(
        F.count(F.lit(1)).cast("double").alias("n_labels"), F.avg("n").alias("mean_label_size"))
    return (
        picked
        .unionByName(_as_stats(points, ["points", "labels_per_point", "dense_fraction"]))
        .unionByName(_as_stats(sizes, ["n_labels", "mean_label_size"]))
    )


def _as_stats(one_row: DataFrame, names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in names])
    return one_row.select(F.explode(cells).alias("c")).select(
        "c.stat", F.lit(None).cast("string").alias("label"), "c.value")


def split_by_label(df: DataFrame) -> DataFrame:
    """``(label, local_id, id, vec)``: one vector set per label with its own dense ids.

    Ids come from one global sort by (label, id), so a hot label is not one window partition.
    """
    rows = number_rows(point_labels(df).select("label", "id").distinct(), ["label", "id"], "_at")
    first = small_or_same(rows.groupBy("label").agg(F.min("_at").alias("_first")))
    local = rows.join(first, "label").select("label", (F.col("_at") - F.col("_first")).alias("local_id"), "id")
    return local.join(df.select("id", "vec"), "id").select("label", "local_id", "id", "vec")


def label_entry_points(df: DataFrame, seed: int = 0) -> DataFrame:
    """``(label, id)``: one start point per label, spread so that few labels share a point.

    Each label has up to 25 candidates in seeded order. A label whose pick is also the pick of a
    smaller label moves to its first candidate that is least used, until no round leaves fewer labels
    sharing a point.
    """
    order = Window.partitionBy("label").orderBy("_h", "id")
    candidates = stored(
        point_labels(df).select("label", "id").distinct()
        .withColumn("_h", seeded_order(seed, "label", "id"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= START_CANDIDATES)
        .select("label", "id", "n"),
        "start-candidates",
    )
    picks = candidates.where("n = 1").select("label", "id")
    spare = picks.count() - picks.select("id").distinct().count()
    while spare:
        shared = Window.partitionBy("id").orderBy("label")
        placed = picks.withColumn("_r", F.row_number().over(shared))
        keep = placed.where("_r = 1").select("label", "id")
        moving = placed.where("_r > 1").select("label")
        used = keep.groupBy("id").agg(F.count(F.lit(1)).alias("_used"))
        again = (
            candidates.join(moving, "label").join(used, "id", "left")
            .groupBy("label").agg(F.min(F.struct(F.coalesce("_used", F.lit(0)).alias("u"), "n", "id")).alias("_best"))
            .select("label", "_best.id")
        )
        moved = stored(keep.unionByName(again), "starts")
        left = moved.count() - moved.select("id").distinct().count()
        if left >= spare:
            break
        picks, spare = moved, left
    return picks


def breakup_dense(df: DataFrame, density: int) -> tuple[DataFrame, DataFrame]:
    """Points with more than ``density`` labels are cut into clones of at most so many.

    Returns ``(id, labels, vec)`` and the map ``(clone, id)``. The first piece keeps its id; clones
    are numbered after the largest id in (id, piece) order.
    """
    pieces = (
        df.withColumn("_n", F.greatest(F.ceil(F.size("labels") / density), F.lit(1)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("labels", F.slice("labels", (F.col("piece") * density + 1).cast("int"), F.lit(density)))
        .drop("_n")
    )
    next_id = df.agg(F.max("id")).first()[0] + 1
    clones = number_rows(pieces.where("piece > 0").select("id", "piece"), ["id", "piece"], "clone", start=next_id)
    clones = stored(clones.select("id", "piece", "clone"), "clones")
    rows = (
        pieces.join(clones, ["id", "piece"], "left")
        .withColumn("id", F.coalesce("clone", "id")).drop("piece", "clone")
    )
    return rows, clones.select("clone", "id")


def undummy(results: DataFrame, clones: DataFrame) -> DataFrame:
    """Real ids instead of clones; an id met several times keeps its smallest distance."""
    real = clones.select(F.col("clone").alias("id"), F.col("id").alias("_real"))
    merged = (
        results.join(real, "id", "left").withColumn("id", F.coalesce("_real", "id"))
        .groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    )
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return merged.withColumn("rank", F.row_number().over(order)).select("qid", "rank", "id", "dist")


def shard_labels(shard_map: DataFrame, labels: DataFrame) -> DataFrame:
    """``(shard, id, labels)``: the labels of each shard's points."""
    return shard_map.select("shard", "id").join(labels.select("id", "labels"), "id").select("shard", "id", "labels")


def sample_query_labels(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n labels drawn from the points' label occurrences, so by frequency: ``(draw, label)``."""
    drawn = (
        point_labels(df).withColumn("_h", seeded_order(seed, "id", "pos"))
        .orderBy("_h", "id", "pos").limit(n)
    )
    order = Window.orderBy("_h", "id", "pos")  # n rows
    return drawn.withColumn("draw", F.row_number().over(order)).select("draw", "label")


def merge_label_starts(starts: DataFrame, shard_ids: DataFrame) -> DataFrame:
    """``(label, id)`` starts of all shards, from ``(shard, label, local_id)`` by the shard's id map."""
    return starts.join(shard_ids, ["shard", "local_id"]).select("label", "id").distinct()


def query_label_starts(starts: DataFrame) -> DataFrame:
    """``(label, starts ARRAY<BIGINT>)`` in the form filtered search takes."""
    return starts.groupBy("label").agg(F.array_sort(F.collect_set("id")).alias("starts"))


