"""Product quantization: training, encoding, asymmetric distances, re-ranked search.

A :class:`Quantizer` is a few tables whose size is set by the codebook (at most 512 chunks of 256
centres), never by the data, so its arrays may be sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import DEFAULTS
from ..functions.distances import ip_dist, l2sq
from ..plans.arrays import Block, add_exact, list_column, matrix, pair_distance
from ..plans.scratch import stored
from ..plans.sums import group_sums, vector_means
from .knn import nearest_pairs, rank_results
from .shards import sample_vectors

GB = 1 << 30
SLICE = 1 << 15       # rows of a training sample that are worked on at once
CACHE_GB = 0.25       # fixed value: share held back for cached nodes
CACHE_FROM_GB = 1.0   # fixed value: only when more than this remains


@dataclass
class Quantizer:
    chunks: DataFrame            # (chunk, lo, hi)
    codebook: DataFrame          # (chunk, code, centroid)
    mean: DataFrame              # one row (vec): subtracted before encoding
    rotation: DataFrame | None = None  # (row, vec)

    def arrays(self) -> Codebook:
        chunks = sorted((r.chunk, r.lo, r.hi) for r in self.chunks.collect())
        rows = self.codebook.toArrow()
        chunk = rows.column("chunk").to_numpy()
        code = rows.column("code").to_numpy()
        cents = rows.column("centroid").combine_chunks()
        books = []
        for c, lo, hi in chunks:
            at = np.flatnonzero(chunk == c)
            at = at[np.argsort(code[at])]
            if not np.array_equal(code[at], np.arange(len(at))):
                raise ValueError(f"codes of chunk {c} must count from 0")
            books.append(matrix(cents.take(pa.array(at))).reshape(len(at), hi - lo))
        mean = np.asarray(self.mean.first()[0], float)
        turn = None
        if self.rotation is not None:
            turn = np.asarray([r.vec for r in self.rotation.orderBy("row").collect()], float)
        return Codebook([(lo, hi) for _, lo, hi in chunks], books, mean, turn)


@dataclass
class Codebook:
    """The arrays of a quantizer as tasks use them."""

    bounds: list[tuple[int, int]]
    books: list[np.ndarray]
    mean: np.ndarray
    turn: np.ndarray | None

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.turn is None else x @ self.turn

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return self.turned(x - self.mean)

    def sides(self, metric: str, q: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and code rows in one space.

        An inner product leaves the mean out, which adds the same to all rows of a query.
        """
        if metric == "l2":
            return self.prepare(q), self.inflate(codes)
        if metric == "mips":
            return self.turned(q), self.inflate(codes)
        return q, self.restore(codes)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Code of the nearest centre per chunk of prepared rows; the smaller code wins a tie."""
        codes = np.empty((len(x), len(self.books)), np.int16)
        at = np.arange(len(x))
        for c, ((lo, hi), book) in enumerate(zip(self.bounds, self.books)):
            codes[:, c] = Block(np.arange(len(book)), book, "l2").nearest(at, x[:, lo:hi], 1)[1]
        return codes

    def inflate(self, codes: np.ndarray) -> np.ndarray:
        """Centres put together; still centred and rotated."""
        return np.hstack([book[codes[:, c]] for c, book in enumerate(self.books)])

    def restore(self, codes: np.ndarray) -> np.ndarray:
        x = self.inflate(codes)
        return (x if self.turn is None else x @ self.turn.T) + self.mean


def _send(spark: SparkSession, quantizer: Quantizer):
    """A function that gives the codebook inside tasks; plain arrays travel, so workers need no package."""
    book = quantizer.arrays()
    held = spark.sparkContext.broadcast((book.bounds, book.books, book.mean, book.turn))
    return lambda: Codebook(*held.value)


def pq_chunks(spark: SparkSession, dim: int, n_chunks: int) -> DataFrame:
    """``(chunk, lo, hi)``: contiguous chunks; the first ``dim mod n`` are one dimension wider."""
    if not 1 <= n_chunks <= min(dim, DEFAULTS["pq_max_chunks"]):
        raise ValueError(f"chunks must be between 1 and {min(dim, DEFAULTS['pq_max_chunks'])}, not {n_chunks}")
    width, wider = divmod(dim, n_chunks)
    c = F.col("id")
    return spark.range(n_chunks).select(
        c.cast("int").alias("chunk"),
        (c * width + F.least(c, F.lit(wider))).cast("int").alias("lo"),
        ((c + 1) * width + F.least(c + 1, F.lit(wider))).cast("int").alias("hi"),
    )


def pq_plan(df: DataFrame, dim: int, budget_gb: float) -> DataFrame:
    """One row ``(n, budget_bytes, chunks)``: bytes per vector that fit the budget, in [1, dim, 512]."""
    held = budget_gb - CACHE_GB if budget_gb - CACHE_GB > CACHE_FROM_GB else budget_gb
    n = F.count(F.lit(1))
    return df.agg(n.alias("n")).select(
        "n", F.lit(held * GB).alias("budget_bytes"),
        F.greatest(F.lit(1), F.least(
            F.floor(F.lit(held * GB) / F.col("n")), F.lit(dim), F.lit(DEFAULTS["pq_max_chunks"]))
        ).cast("long").alias("chunks"),
    )


def _training_rows(df: DataFrame, rows: int, seed: int) -> DataFrame:
    n = df.count()
    return stored(sample_vectors(df.select("id", "vec"), rows / max(n, 1), seed), "pq-sample")


def _mean_row(df: DataFrame, center: bool) -> DataFrame:
    mean = vector_means(df.select("vec", F.lit(0).alias("_g")), "_g").select("vec")
    return stored(mean if center else mean.select(F.transform("vec", lambda x: F.lit(0.0)).alias("vec")), "pq-mean")


def _seeded_lloyd(x: np.ndarray, k: int, reps: int, seed: int) -> np.ndarray:
    """k-means++ starts and Lloyd steps over one chunk of a bounded sample; empty centres stay.

    ``x`` is sorted in place, and besides it only a few numbers per row are held at a time.
    """
    rng = np.random.default_rng(seed)
    order = np.lexsort(x.T)
    for c in range(x.shape[1]):
        x[:, c] = x[order, c]
    del order
    parts = [slice(a, a + SLICE) for a in range(0, len(x), SLICE)]
    centers = [x[rng.integers(len(x))].copy()]
    gap = np.concatenate([((x[s] - centers[0]) ** 2).sum(1) for s in parts])
    while len(centers) < min(k, len(x)):
        total = gap.sum()
        if total <= 0:
            break
        centers.append(x[min(np.searchsorted(np.cumsum(gap), rng.random() * total), len(x) - 1)].copy())
        for s in parts:
            gap[s] = np.minimum(gap[s], ((x[s] - centers[-1]) ** 2).sum(1))
    out = np.array(centers)
    last = np.inf
    for _ in range(reps):
        block, sums, counts, d = Block(np.arange(len(out)), out, "l2"), np.zeros(out.shape), np.zeros(len(out), np.int64), gap
        for s in parts:
            _, at, d[s] = block.nearest(np.arange(len(x[s])), x[s], 1)
            np.add.at(sums, at, x[s])
            counts += np.bincount(at, minlength=len(out))
        out = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], out)
        if last < np.inf and (last - d.sum()) <= 1e-5 * last:
            break
        last = d.sum()
    return out


def _train_chunks(
    prepared: DataFrame, chunks: DataFrame, centers: int, reps: int, seed: int, arrays: tuple[np.ndarray, np.ndarray | None],
) -> DataFrame:
    """``(chunk, code, centroid)``: the chunks train in parallel, each on its slice of the sample."""
    bounds = {r.chunk: (r.lo, r.hi) for r in chunks.collect()}
    mean, turn = arrays

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column(0)) - mean
            x = x if turn is None else x @ turn
            for c, (lo, hi) in bounds.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), list_column(x[:, lo:hi], pa.float64())], ["chunk", "part"])

    n_rows = prepared.count()

    def train(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = key[0].as_py()
        lo, hi = bounds[c]
        x, n = np.empty((n_rows, hi - lo)), 0
        for batch in batches:  # each is copied into place and let go
            x[n:n + batch.num_rows] = matrix(batch.column("part"))
            n += batch.num_rows
        out = _seeded_lloyd(x[:n], centers, reps, seed + c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(out), c, np.int32)), pa.array(np.arange(len(out), dtype=np.int32)), list_column(out, pa.float64())],
            ["chunk", "code", "centroid"])

    parts = prepared.select("vec").mapInArrow(cut, "chunk int, part array<double>")
    return parts.groupBy("chunk").applyInArrow(train, "chunk int, code int, centroid array<double>")


def pq_train(
    df: DataFrame, n_chunks: int, center: bool = True, centers: int = DEFAULTS["pq_centers"],
    reps: int = DEFAULTS["pq_reps"], seed: int = 1, rows: int = DEFAULTS["pq_train_rows"],
    codebook: DataFrame | None = None,
) -> Quantizer:
    """Train on a bounded sample of ``(id, vec)``. A given ``codebook`` is reused as it is.

    ``center=False`` gives the quantizer of stored vectors, which keeps the mean.
    """
    sample = _training_rows(df, rows, seed)
    dim = len(sample.select("vec").first()[0])
    chunks = pq_chunks(df.sparkSession, dim, n_chunks)
    mean = _mean_row(sample, center)
    if codebook is None:
        codebook = stored(
            _train_chunks(sample, chunks, centers, reps, seed, (np.asarray(mean.first()[0]), None)), "codebook")
    return Quantizer(chunks, codebook, mean)


def opq_train(
    df: DataFrame, n_chunks: int, rounds: int = DEFAULTS["opq_rounds"], centers: int = DEFAULTS["pq_centers"],
    reps: int = DEFAULTS["opq_reps"], seed: int = 1, rows: int = DEFAULTS["pq_train_rows"],
) -> Quantizer:
    """Quantizer with a rotation: each round trains the chunks and turns the data toward its codes.

    The driver only sees the dim x dim correlation, which Spark adds up over the sample.
    """
    sample = _training_rows(df, rows, seed)
    spark = df.sparkSession
    dim = len(sample.select("vec").first()[0])
    chunks = pq_chunks(spark, dim, n_chunks)
    mean = _mean_row(sample, True)
    mean_row = np.asarray(mean.first()[0])
    turn = np.eye(dim)
    for _ in range(rounds):
        book = stored(_train_chunks(sample, chunks, centers, reps, seed, (mean_row, turn)), "opq-book")
        held = _send(spark, Quantizer(chunks, book, mean))

        def partial(table: pa.Table, turn=turn, held=held):
            known = held()
            x = matrix(table.column("vec")) - known.mean
            quantized = known.inflate(known.encode(x @ turn))
            return pa.array([0], pa.int64()), (x.T @ quantized).reshape(1, -1)

        total = group_sums(sample.select("vec"), T.LongType(), "g", partial).first()["sums"]
        u, _, vt = np.linalg.svd(np.asarray(total).reshape(dim, dim))
        turn = u @ vt
    book = stored(_train_chunks(sample, chunks, centers, reps, seed, (mean_row, turn)), "opq-book")
    rotation = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(turn)], "row int, vec array<double>")
    return Quantizer(chunks, book, mean, rotation)


def _map_vectors(df: DataFrame, col: str, out: str, out_type: T.DataType, fn, keep: list[str]) -> DataFrame:
    """Replace array column ``col`` by ``fn(matrix)`` batch by batch."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(out_type))])
    value_type = pa.int16() if isinstance(out_type, T.ShortType) else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            rows = fn(matrix(table.column(col)))
            yield from table.select(keep).append_column(out, list_column(rows, value_type)).to_batches()

    return df.select(*keep, col).mapInArrow(run, schema)


def pq_preprocess(df: DataFrame, quantizer: Quantizer, col: str = "qvec", key: str = "qid", center: bool = True) -> DataFrame:
    """Rows centred and rotated as the codes are; only rotated without ``center``."""
    held = _send(df.sparkSession, quantizer)
    return _map_vectors(df, col, col, T.DoubleType(), lambda x: held().prepare(x) if center else held().turned(x), [key])


def pq_encode(df: DataFrame, quantizer: Quantizer) -> DataFrame:
    """``(id, codes ARRAY<SMALLINT>)``; a map over the vectors, no shuffle."""
    held = _send(df.sparkSession, quantizer)
    return _map_vectors(df, "vec", "codes", T.ShortType(), lambda x: held().encode(held().prepare(x)), ["id"])


def pq_decode(codes: DataFrame, quantizer: Quantizer) -> DataFrame:
    """``(id, vec)``: approximate vectors from codes."""
    held = _send(codes.sparkSession, quantizer)
    return _map_vectors(codes, "codes", "vec", T.DoubleType(), lambda c: held().restore(c.astype(np.int64)), ["id"])


def reconstruction_error(df: DataFrame, codes: DataFrame, quantizer: Quantizer) -> DataFrame:
    """One row ``(n, mean_error)``: mean squared distance of vectors to what their codes restore."""
    near = pq_decode(codes, quantizer).withColumnRenamed("vec", "_near")
    return df.join(near, "id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(l2sq("vec", "_near")).alias("mean_error"))


def adc_table(queries: DataFrame, quantizer: Quantizer, metric: str = "l2") -> DataFrame:
    """``(qid, chunk, code, value)``: distance of each query chunk to each centre.

    L2 uses centred and rotated queries; the inner product (``mips``) only rotates them.
    """
    queries = pq_preprocess(queries, quantizer, center=metric == "l2")
    parts = queries.select("qid", F.explode(_chunk_structs(quantizer)).alias("c")).select("qid", "c.chunk", "c.part")
    value = l2sq("part", "centroid") if metric == "l2" else ip_dist("part", "centroid")
    book = F.broadcast(quantizer.codebook)  # at most 512 x 256 rows
    return parts.join(book, "chunk").select("qid", "chunk", "code", value.alias("value"))


def _chunk_structs(quantizer: Quantizer):
    bounds = sorted((r.chunk, r.lo, r.hi) for r in quantizer.chunks.collect())
    return F.array(*[
        F.struct(F.lit(c).alias("chunk"), F.slice("qvec", lo + 1, hi - lo).alias("part")) for c, lo, hi in bounds])


def pq_distance(pairs: DataFrame, quantizer: Quantizer, metric: str = "l2") -> DataFrame:
    """``(qid, id, dist)`` of rows ``(qid, qvec, id, codes)``, straight from the codes."""
    held = _send(pairs.sparkSession, quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = held()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            q, x = book.sides(metric, matrix(table.column("qvec")), matrix(table.column("codes"), np.int64))
            d = pair_distance(metric, q, x)
            yield from table.select(["qid", "id"]).append_column("dist", pa.array(d)).to_batches()

    return pairs.select("qid", "qvec", "id", "codes").mapInArrow(run, "qid long, id long, dist double")


def adc_scan(
    queries: DataFrame, codes: DataFrame, quantizer: Quantizer, k: int, metric: str = "l2", skip_same: bool = False,
) -> DataFrame:
    """k best rows per query by code distance: the sum of the query's table entries over the codes.

    A sum of per-chunk distances is the distance to the inflated codes, so blocks of codes are
    inflated inside the task and scored by one matrix product.
    """
    held = _send(codes.sparkSession, quantizer)
    asked = pq_preprocess(queries, quantizer, center=metric == "l2")

    def rows(table: pa.Table) -> np.ndarray:
        return held().inflate(matrix(table.column("codes"), np.int64))

    return rank_results(nearest_pairs(codes, asked, k, metric, skip_same, rows=rows, payload="codes"), k)


def pq_search(
    queries: DataFrame, codes: DataFrame, base: DataFrame, quantizer: Quantizer, k: int,
    mult: int = DEFAULTS["rerank_multiplier"], skip_same: bool = False,
) -> DataFrame:
    """Best mult * k rows by codes, then the k best of them by full vectors."""
    candidates = adc_scan(queries, codes, quantizer, k * mult, skip_same=skip_same).select("qid", "id")
    scored = (
        candidates.join(base.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
        .select("qid", "id", l2sq("vec", "qvec").alias("dist"))
    )
    return rank_results(scored, k)
