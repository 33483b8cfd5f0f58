"""Mixing sources to target weights: word budgets filled by bounded subset sums over document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import WORD, seeded_hash
from vecloom.plans.numbering import number_rows
from vecloom.plans.scratch import stored

#: Weights of the sources in order, share of all words to take, most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in code point order, null last, take ``weights`` in turn and split ``share`` of all words by them;
    a target stops at ``most`` times its source's size and the excess is split again until none is above.
    """
    ordered = sizes.withColumn("_null", F.col("source").isNull())
    numbered = number_rows(ordered, ["_null", "source"], "_n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    rows = stored(
        numbered.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * most).cast("double").alias("_cap")),
        "sources")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        # Two sums leave each round; a source that reached its cap stays there, as the level only rises.
        full = F.col("_w") * level >= F.col("_cap")
        capped, open_weight = rows.agg(
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        if not open_weight:
            break
        higher = max(0.0, total - capped) / open_weight
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("_cap"), F.col("_w") * level)
    return rows.select("source", "source_size", target.alias("target"))


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: float, window: int = 1 << 16, widest: int = 1 << 22) -> np.ndarray:
    """How many documents of each length to take so that their words come as near ``budget`` as possible; of two sums as near, the lower.

    An even share of every length is taken first, longest ones added while more than ``window`` words are left. A bounded
    knapsack then both adds and takes back: it holds the sums reachable within a window around the present one, each
    length's count in powers of two, and for each sum the step that reached it first, so that memory is a few bytes a sum.
    It ends when the budget is met (to the common divisor of the lengths); else the window grows until it spans all sums,
    which makes the answer the nearest of all, or ``widest`` units, which makes it the nearest by that much change.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    counts = np.where(lengths > 0, counts, 0)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, total, goal = lengths // unit, total // unit, budget / unit
    taken = np.minimum(counts, (counts * (goal / total)).astype(np.int64))
    rest = goal - int((taken * lengths).sum())
    order = [i for i in np.argsort(lengths, kind="stable").tolist() if counts[i] > 0]
    for i in reversed(order):
        if rest > window:
            more = min(int(counts[i] - taken[i]), int(rest // lengths[i]))
            taken[i] += more
            rest -= more * int(lengths[i])
    spare = [i for i in order if taken[i] < counts[i]]
    if rest > widest and spare and lengths[spare[0]] < 2 * rest:  # all that is left is longer than the rest
        taken[spare[0]] += 1
        rest -= int(lengths[spare[0]])
    for i in reversed(order):
        if rest < -window:
            back = min(int(taken[i]), int(-rest // lengths[i]))
            taken[i] -= back
            rest += back * int(lengths[i])
    width, last = min(window, total), min(total, max(widest, window))
    while True:
        moved, met = _nearest_change(lengths, counts - taken, taken, order, rest, width)
        if met or width >= last:
            return taken + moved
        width = min(16 * width, last)


def _nearest_change(lengths, more, less, order, rest: float, width: int) -> tuple[np.ndarray, bool]:
    """Documents to add (or, negative, to take back) for a sum nearest ``rest`` within ``width``; and whether none can be nearer."""
    reached, first, steps = np.zeros(2 * width + 1, bool), np.zeros(2 * width + 1, np.int32), [(0, 0)]
    reached[width] = True
    ideal = int(np.ceil(rest - 0.5))
    inside = abs(ideal) <= width
    for i in order:
        for sign, free in ((1, int(more[i])), (-1, int(less[i]))):
            size, piece = int(lengths[i]), 1
            free = min(free, 2 * width // size)
            while free > 0 and not (inside and reached[width + ideal]):
                k = min(piece, free)
                shift, free, piece = k * size, free - k, piece * 2
                old, new = slice(0, 2 * width + 1 - shift), slice(shift, None)
                if sign < 0:
                    old, new = new, old
                fresh = reached[old] & ~reached[new]
                first[new][fresh] = len(steps)
                reached[new] |= fresh
                steps.append((i, sign * k))
    sums = np.flatnonzero(reached) - width
    at = int(sums[np.abs(sums - rest).argmin()])
    moved, met = np.zeros(len(lengths), np.int64), at == ideal
    while at:
        i, k = steps[first[width + at]]
        moved[i] += k
        at -= k * int(lengths[i])
    return moved, met


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 20,
) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)``, one row per input row.

    ``size`` counts words (null text: 0), ``copies`` how often the mix takes the row (0 to ``most``), ``taken`` its
    words times copies. Each source's words taken are the reachable sum nearest its target, as ``subset_sum`` states it; the
    copies of one length go round its rows evenly. Which rows of one source and length are taken more often is decided by a
    seeded hash of the id; rows repeated with one id are separate rows.
    A null source is a source; a row of 0 words is never taken; no rows give no rows; other columns are ignored.

    Only ``(source, length, rows)`` counts of a source meet in one task: at most as many rows as it has different
    lengths. Ranks inside a (source, length) come from a global range sort on the hash, so that no such group,
    whatever its share of the rows, meets in one place.
    """
    sized = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix")
    lengths = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix")
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = stored(source_targets(totals, weights, share, most), "mix")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        size, rows = group["size"].to_numpy(np.int64), group["rows"].to_numpy(np.int64)
        copies = subset_sum(size, rows * most, float(group["target"].iloc[0]))
        return group.assign(whole=copies // rows, extra=copies % rows)

    same = F.col("l.source").eqNullSafe(F.col("t.source"))
    plan = stored(
        lengths.alias("l").join(targets.alias("t"), same).select("l.source", "size", "rows", "source_size", "target")
        .groupBy("source").applyInPandas(
            fill, "source string, size bigint, rows bigint, source_size bigint, target double, whole bigint, extra bigint"),
        "mix")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "size", "_h", "doc_id"]
    ranked = stored(
        sized.withColumn("_h", seeded_hash(seed, "doc_id")).repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "mix")
    # Per partition and group: where the group starts there, and its rows in earlier partitions.
    pieces = ranked.groupBy("_part", "source", "size").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    p, q = pieces.alias("p"), plan.alias("q")
    pieces = p.join(q, F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.size") == F.col("q.size"))).select(
        "_part", F.col("p.source").alias("source"), F.col("p.size").alias("size"), "_first", "_before",
        "source_size", "target", "whole", "extra")
    r, p = ranked.alias("r"), pieces.alias("p")
    found = r.join(
        p, (F.col("r._part") == F.col("p._part")) & F.col("r.source").eqNullSafe(F.col("p.source"))
        & (F.col("r.size") == F.col("p.size")))
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    copies = F.col("whole") + F.when(rank < F.col("extra"), 1).otherwise(0)
    return found.select(
        F.col("r.doc_id").alias("doc_id"), F.col("r.size").alias("size"), "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("r.size")).cast("long").alias("taken"))
