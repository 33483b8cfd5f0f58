"""Codebooks trained on all rows: seeding in rounds and Lloyd steps, all chunks in one pass over the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import DEFAULTS
from ..plans.arrays import Block, add_exact, list_column, longs, matrix
from ..plans.scratch import stored
from .pq import Codebook, Quantizer, _mean_row, _send, pq_chunks

ROWS = 4_096
SEED_ROUNDS = 5


def _nearest(book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of the nearest centre of each row; the smaller code wins a tie."""
    _, at, d = Block(np.arange(len(book)), book, "l2").nearest(np.arange(len(x)), x, 1)
    return at, d


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 per id, the same in every run."""
    h = (ids.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _parts(batches: Iterator[pa.RecordBatch], known: Codebook) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and prepared rows, a bounded number at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield longs(part.column("id")), known.prepare(matrix(part.column("vec")))


def chunk_sums(df: DataFrame, quantizer: Quantizer) -> DataFrame:
    """``(chunk, code, n, residual, sums)``: what one Lloyd step needs, of every row and chunk.

    A task adds its rows up as it reads them and hands on one row per centre it met. What is shuffled has the size of the
    codebook times the number of tasks; no centre's rows ever meet.
    """
    held = _send(df.sparkSession, quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held()
        wide = [np.zeros((len(book), hi - lo + 2)) for (lo, hi), book in zip(known.bounds, known.books)]
        for _, x in _parts(batches, known):
            for c, ((lo, hi), book) in enumerate(zip(known.bounds, known.books)):
                at, d = _nearest(book, x[:, lo:hi])
                sums, n = add_exact(at, len(book), np.hstack([x[:, lo:hi], d[:, None]]))
                wide[c][:, :-1] += sums
                wide[c][:, -1] += n
        for c, total in enumerate(wide):
            met = np.flatnonzero(total[:, -1] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(met), c, np.int32)), pa.array(met.astype(np.int32)), list_column(total[met], pa.float64())],
                ["chunk", "code", "part"])

    cells = df.select("id", "vec").mapInArrow(run, "chunk int, code int, part array<double>").select(
        "chunk", "code", F.posexplode("part").alias("pos", "x"))
    rows = cells.groupBy("chunk", "code", "pos").agg(F.sum("x").alias("x")).groupBy("chunk", "code").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_c")).select(
        "chunk", "code", F.transform("_c", lambda c: c["x"]).alias("_x"))
    return rows.select(
        "chunk", "code", F.element_at("_x", -1).cast("long").alias("n"), F.element_at("_x", -2).alias("residual"),
        F.slice("_x", 1, F.size("_x") - 2).alias("sums"))


def lloyd_chunks(df: DataFrame, quantizer: Quantizer) -> tuple[Quantizer, float]:
    """One Lloyd step of all chunks over all rows, and the squared error before it; a centre without rows stays."""
    step = stored(chunk_sums(df, quantizer), "pq-step")
    means = step.select("chunk", "code", F.transform("sums", lambda x: x / F.col("n")).alias("_mean"))
    book = quantizer.codebook.join(means, ["chunk", "code"], "left").select(
        "chunk", "code", F.coalesce("_mean", F.col("centroid").cast("array<double>")).alias("centroid"))
    error = step.agg(F.sum("residual")).first()[0] or 0.0
    return Quantizer(quantizer.chunks, stored(book, "pq-book"), quantizer.mean, quantizer.rotation), error


def _seeds(df: DataFrame, start: Quantizer, centers: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidates and the rows nearest to each, per chunk: each round adds about ``2 * centers`` rows by their distance.

    What reaches the driver is bounded by the parameters: chunks times rounds times a few centres.
    """
    chosen = start
    for round_ in range(SEED_ROUNDS):
        step = chunk_sums(df, chosen).groupBy("chunk").agg(F.sum("residual").alias("r")).collect()
        error = {r.chunk: r.r for r in step}
        held = _send(df.sparkSession, chosen)

        def draw(batches: Iterator[pa.RecordBatch], held=held, error=error, round_=round_) -> Iterator[pa.RecordBatch]:
            known = held()
            for ids, x in _parts(batches, known):
                for c, ((lo, hi), book) in enumerate(zip(known.bounds, known.books)):
                    if not error.get(c):
                        continue
                    _, d = _nearest(book, x[:, lo:hi])
                    hit = _uniform(ids, seed + 1000 * round_ + 7919 * c) * error[c] < 2.0 * centers * d
                    if hit.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(int(hit.sum()), c, np.int32)), pa.array(ids[hit]), list_column(x[hit, lo:hi], pa.float64())],
                            ["chunk", "id", "centroid"])

        found = df.select("id", "vec").mapInArrow(draw, "chunk int, id long, centroid array<double>")
        books = chosen.arrays().books
        rows = found.select("chunk", "centroid").distinct().orderBy("chunk", "centroid").collect()
        for c in range(len(books)):
            new = [r.centroid for r in rows if r.chunk == c]
            books[c] = np.vstack([books[c], np.array(new).reshape(len(new), books[c].shape[1])])
        chosen = _quantizer(start, books)
    counts = chunk_sums(df, chosen).select("chunk", "code", "n").collect()
    books = chosen.arrays().books
    weights = [np.zeros(len(b)) for b in books]
    for r in counts:
        weights[r.chunk][r.code] = r.n
    return list(zip(books, weights))


def _quantizer(like: Quantizer, books: list[np.ndarray]) -> Quantizer:
    rows = [(c, n, row.tolist()) for c, book in enumerate(books) for n, row in enumerate(book)]
    book = like.codebook.sparkSession.createDataFrame(rows, "chunk int, code int, centroid array<double>")
    return Quantizer(like.chunks, stored(book, "pq-book"), like.mean, like.rotation)


def _reduced(x: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted candidates, each drawn by its weight and its distance from those drawn."""
    x, weights = x[weights > 0], weights[weights > 0]
    rng = np.random.default_rng(seed)
    out = [x[np.searchsorted(np.cumsum(weights), rng.random() * weights.sum())]]
    gap = ((x - out[0]) ** 2).sum(axis=1)
    while len(out) < min(k, len(x)) and (gap * weights).sum() > 0:
        total = np.cumsum(gap * weights)
        out.append(x[min(np.searchsorted(total, rng.random() * total[-1], side="right"), len(x) - 1)])
        gap = np.minimum(gap, ((x - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def pq_train_all(
    df: DataFrame, n_chunks: int, center: bool = True, centers: int = DEFAULTS["pq_centers"],
    reps: int = DEFAULTS["pq_reps"], seed: int = 1, gain: float = 1e-4,
) -> tuple[Quantizer, list[float]]:
    """A quantizer trained on every row of ``(id, vec)``, and the squared error before each Lloyd step.

    Mean, seeds and steps come from passes over the whole table that all chunks share; the steps end when one gains
    less than ``gain``. ``center=False`` gives the quantizer of stored vectors, which keeps the mean.
    """
    spark = df.sparkSession
    head = df.orderBy("id").select("vec").first()
    if head is None:
        raise ValueError("there are no rows to train on")
    chunks, mean = pq_chunks(spark, len(head.vec), n_chunks), _mean_row(df, center)
    first = np.asarray(head.vec, float) - np.asarray(mean.first()[0], float)
    bounds = sorted((r.chunk, r.lo, r.hi) for r in chunks.collect())
    book = spark.createDataFrame([(c, 0, first[lo:hi].tolist()) for c, lo, hi in bounds], "chunk int, code int, centroid array<double>")
    seeds = _seeds(df, Quantizer(chunks, stored(book, "pq-first"), mean), centers, seed)
    books = [_reduced(x, w, centers, seed + c) for c, (x, w) in enumerate(seeds)]
    quantizer, errors = _quantizer(Quantizer(chunks, book, mean), books), []
    for _ in range(reps):
        quantizer, error = lloyd_chunks(df, quantizer)
        errors.append(error)
        if len(errors) > 1 and errors[-2] - error <= gain * errors[-2]:
            break
    return quantizer, errors
