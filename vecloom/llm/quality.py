"""Quality classifier: importance weights of hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import Ids, indexed, seeded_hash, slices, texts_of
from vecloom.plans.numbering import number_rows


class Hasher:
    """Buckets of the words and word pairs of texts; words use the lower half of the buckets."""

    def __init__(self, buckets: int):
        self.half, self.ids, self.hashes = buckets // 2, Ids(), np.zeros(1 << 14, np.uint64)

    def buckets(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams, and the row each belongs to."""
        if len(self.ids) > 500_000:
            self.ids = Ids()
        first = len(self.ids)
        words, starts = indexed(texts, self.ids)
        n = len(self.ids)
        if n > len(self.hashes):
            self.hashes = np.resize(self.hashes, 2 * n)
        if n > first:
            new = list(self.ids)[first:] if first else list(self.ids)
            self.hashes[first:n] = np.fromiter(map(zlib.crc32, new), np.uint64, n - first)
        h = self.hashes[words]
        row = np.repeat(np.arange(len(texts)), np.diff(starts))
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)
        inside = row[:-1] == row[1:]
        ones, twos = h % np.uint64(self.half), self.half + pair[inside] % np.uint64(self.half)
        return np.concatenate([ones, twos]).astype(np.int64), np.concatenate([row, row[1:][inside]])


def ngram_ratio(docs: DataFrame, buckets: int = 1 << 15) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | all), from ``(text, target)``; one pass, two histograms per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        counts = np.zeros((2, buckets), np.int64)
        for batch in slices(batches):
            at, row = hasher.buckets(texts_of(batch))
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[row]
            counts[0] += np.bincount(at, minlength=buckets)
            counts[1] += np.bincount(at[chosen], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(counts[0]), pa.array(counts[1])], ["b", "n", "t"])

    sums = docs.select("text", "target").mapInArrow(run, "b bigint, n bigint, t bigint").groupBy("b").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    n, t = np.ones(buckets), np.ones(buckets)
    at = sums.column("b").to_numpy()
    n[at] += sums.column("n").to_numpy()
    t[at] += sums.column("t").to_numpy()
    return np.log(t / t.sum()) - np.log(n / n.sum())


def importance_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
    share: float | None = None, max_labelled: int = 100_000, buckets: int = 1 << 15, seed: int = 9,
) -> DataFrame:
    """``(doc_id, log_weight, score, kept)``, one row per input row.

    ``log_weight`` sums over the row's words and word pairs the log ratio of two hashed n-gram models: the rows
    labelled good, and all rows. ``score`` is its mean per n-gram through the logistic function. ``kept`` marks
    the k rows with the largest log_weight + Gumbel noise, which is a sample without replacement in proportion to the
    weights; k is ``share`` of the rows, by default the good labels' share of the labels. The noise is a
    seeded hash of the id, so reruns agree; ties go by id, null ids first, rows repeated with one id one by one.

    The target model is fitted on the good ones among at most ``max_labelled`` labels, chosen by a seeded
    hash; the model of all rows reads every row. A null or wordless text has weight 0; no rows give no rows.
    Labels that are null or of unknown documents teach nothing.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(quality_col).alias("_q")).where("_id IS NOT NULL AND _q IS NOT NULL")
    fitted = known.orderBy(seeded_hash(seed, "_id"), "_id").limit(max_labelled)
    good = fitted.where("_q > 0").select("_id").distinct()
    if share is None:
        share = known.agg(F.avg((F.col("_q") > 0).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows.join(F.broadcast(good), rows.doc_id == good["_id"], "left").select("text", F.col("_id").isNotNull().alias("target"))
    ratio = docs.sparkSession.sparkContext.broadcast(ngram_ratio(marked, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        for batch in slices(batches):
            at, row = hasher.buckets(texts_of(batch))
            n = np.bincount(row, minlength=batch.num_rows)
            w = np.bincount(row, ratio.value[at], minlength=batch.num_rows)
            score = 1.0 / (1.0 + np.exp(-np.clip(w / np.maximum(n, 1), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(score)], ["doc_id", "log_weight", "score"])

    weighed = rows.mapInArrow(weigh, "doc_id bigint, log_weight double, score double")
    uniform = (F.shiftrightunsigned(seeded_hash(seed, "doc_id"), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
    noisy = weighed.withColumn("_key", F.col("log_weight") - F.log(-F.log(uniform)))
    ordered = number_rows(noisy, [F.desc("_key"), "doc_id"], "_rank")
    k = round(share * docs.count())
    return ordered.select("doc_id", "log_weight", "score", (F.col("_rank") < k).alias("kept"))
