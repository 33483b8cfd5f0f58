"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.plans.arrays import list_column, matrix, one_array
from vecloom.plans.scratch import stored

SHIFT = 1_000_000        # fixed value: added to every entry
STEPS = 64               # fixed value: entries are cut to multiples of 1 / STEPS
MOST = 1 << 46           # larger entries count as this, so that sums stay exact
COMPONENTS = 16
ROWS = 4096              # rows multiplied at a time
FIT_BYTES = 16 << 20     # bytes of the fit list that one task reads
RANK = 1e-10             # a deviation at most this share of the largest is rounding, not a component
AGREED = 1e-14           # orthogonality and residuals this small count as reached


def whole_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, x)``: rows with a vector of finite entries, as whole numbers.

    All vectors need one length. Where lengths differ, the most frequent one counts (of equally frequent ones the
    longest) and rows of other lengths are left out like those with null or non-finite entries.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_vec")).where(
        F.col("_vec").isNotNull() & F.forall("_vec", finite))
    length = rows.groupBy(F.size("_vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = length[0].n if length else 0

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c * STEPS, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long") + SHIFT

    return rows.where(F.size("_vec") == dim).select("vec_id", F.transform("_vec", whole).alias("x"))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of ``x`` as matrices of at most ROWS rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield matrix(batch.slice(a, ROWS).column("x"), np.int64)


def totals(fit: DataFrame, width: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the ``width`` values ``add(rows)``; one row a task is shuffled, never rows of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for rows in _tables(batches):
            out += add(rows)
        yield pa.RecordBatch.from_arrays([list_column(out[None, :], pa.float64())], ["sums"])

    cells = fit.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("pos", "x"))
    out = np.zeros(width)
    for r in cells.groupBy("pos").agg(F.sum("x").alias("x")).collect():
        out[r.pos] = r.x
    return out


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * dim, 0
        for rows in _tables(batches):
            n += len(rows)
            sums = [a + int(b) for a, b in zip(sums, (rows - SHIFT).sum(axis=0))]
        values = [n, *[s + n * SHIFT for s in sums]]
        yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in values]], pa.list_(pa.string()))], ["sums"])

    cells = fit.mapInArrow(run, "sums array<string>").select(F.posexplode("sums").alias("pos", "x"))
    whole = cells.groupBy("pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    found = {r.pos: int(r.x) for r in whole}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(dim)]


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n`` with one rounding: ``n * x - S`` is exact."""
    return _deviations(rows, n, sums).astype(np.float64) / n


def _deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S`` as whole numbers, beyond 63 bits as Python's."""
    largest = n * int(np.abs(rows).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if largest < 1 << 62:
        return rows * np.int64(n) - sums.astype(np.int64)
    return rows.astype(object) * n - sums


@dataclass
class Whitening:
    """What the fit leaves: rows ``components`` (unit vectors by falling ``eigenvalues``), and how white the result is."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int


def bidiagonalise(fit: DataFrame, n: int, sums: np.ndarray, wanted: int, seed: int = 0):
    """``(components, deviations, squared norm, passes)`` of the centred rows X of the fit list.

    Step j takes u = X v - beta u' and then w = X'u - alpha v: one pass over the rows makes both products, as a task that
    has its entries of u can multiply its rows with them at once. The u have an entry per row and are never kept: each is X g
    for a short g, so the tasks make the earlier ones again and sum their products with the new one; where these are not
    zero to rounding, g is corrected and the pass repeated. The v are made orthogonal on the driver, twice. A step whose new
    vector vanishes goes on from a seeded random one, so that repeated deviations are found, too. It ends when the v fill the
    space, or when the wanted deviations have settled and all variance not yet seen is less than the least of them.
    """
    dim = len(sums)
    rng = np.random.default_rng(seed)
    basis = np.zeros((dim, 0))
    makes = np.zeros((dim, 0))
    alphas: list[float] = []
    betas: list[float] = []
    norm = passes = 0

    def fresh(x: np.ndarray) -> tuple[np.ndarray, float]:
        """x made orthogonal to the basis, and its length."""
        for _ in range(2):
            x = x - basis @ (basis.T @ x)
        size = float(np.linalg.norm(x))
        return (x / size if size else x), size

    def product(g: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """``X'u``, ``U'u``, ``u'u`` and the squared norm of X, for u = X g and the earlier U = X G."""
        wide = np.hstack([earlier, g[:, None]])

        def add(rows: np.ndarray) -> np.ndarray:
            x = centred(rows, n, sums)
            made = x @ wide
            u = made[:, -1]
            return np.concatenate([x.T @ u, made.T @ u, [np.einsum("ij,ij->", x, x)]])

        out = totals(fit, dim + wide.shape[1] + 1, add)
        return out[:dim], out[dim:-2], out[-2], out[-1]

    v, beta = fresh(rng.normal(size=dim))[0], 0.0
    g_before = np.zeros(dim)
    while True:
        g = v - beta * g_before
        for _ in range(3):
            w, overlap, square, norm = product(g, makes)
            passes += 1
            alpha = float(np.sqrt(max(square, 0.0)))
            if alpha <= AGREED * np.sqrt(norm) or np.abs(overlap).max(initial=0.0) <= AGREED * dim * alpha:
                break
            g = g - makes @ overlap
        if norm == 0.0:
            return np.zeros((0, dim)), np.zeros(0), 0.0, passes
        if alpha <= AGREED * np.sqrt(norm):
            alpha, g, w = 0.0, np.zeros(dim), np.zeros(dim)  # v adds nothing: X v lies in what is known
        else:
            g, w = g / alpha, w / alpha
        basis, makes = np.hstack([basis, v[:, None]]), np.hstack([makes, g[:, None]])
        alphas.append(alpha)
        left, deviations, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1) if betas else np.diag(alphas))
        known = len(alphas)
        v, beta = fresh(w - alpha * basis[:, -1]) if known < dim else (v, 0.0)
        settled = beta * np.abs(left[-1, :wanted]) <= AGREED * deviations[0]
        unseen = norm - float((deviations**2).sum())
        if known == dim or (known >= wanted and settled.all() and unseen < deviations[wanted - 1] ** 2 * (1 - 1e-9)):
            kept = deviations[:wanted] > RANK * deviations[0]
            return (right[:wanted] @ basis.T)[kept], deviations[:wanted][kept], norm, passes
        if beta <= AGREED * np.sqrt(norm):
            v, beta = fresh(rng.normal(size=dim))[0], 0.0
        betas.append(beta)
        g_before = g


def fit_whitening(vectors: DataFrame, wanted: int = COMPONENTS, seed: int = 0) -> tuple[DataFrame, Whitening | None]:
    """The distinct ``x`` of ``vectors(vec_id, x)``, stored, and the whitening they give; None without rows.

    Equal vectors are first merged inside each task, so many copies are never shuffled.
    """
    first = vectors.select(F.size("x").alias("dim")).first()
    if first is None:
        return vectors.select("x"), None
    parts = 1 + vectors.count() * first.dim * 8 // FIT_BYTES
    fit = stored(vectors.select("x").distinct().coalesce(parts), "fit")
    n, whole = exact_sums(fit, first.dim)
    sums = np.array(whole, object)
    components, deviations, norm, passes = bidiagonalise(fit, n, sums, wanted, seed)
    scale = components.T / deviations * np.sqrt(n) if len(deviations) else np.zeros((first.dim, 0))
    k = len(deviations)

    def squares(rows: np.ndarray) -> np.ndarray:
        white = centred(rows, n, sums) @ scale
        return (white.T @ white).reshape(-1)

    error = np.abs(totals(fit, k * k, squares).reshape(k, k) / n - np.eye(k)).max() if k else 0.0
    return fit, Whitening(n, sums, components, deviations**2 / n, norm / n, float(error), passes + 1)


def whiten(
    df: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0,
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per kept row and component.

    Rows without a usable vector (null, null or non-finite entries, another length than most) are left out. Entries beyond
    2**46 / 64 count as that. Rows repeated with one id, or without one, stay rows of their own, but equal vectors are one row of
    the fit. There are as many components as asked for or as the vectors have directions in which they differ (a deviation
    of more than 1e-10 of the largest), so one distinct vector, or none, gives no rows. ``deviation`` is null beyond 63 bits.
    Other columns are ignored.
    """
    vectors = whole_vectors(df, id_col, vec_col)
    _, made = fit_whitening(vectors, wanted, seed)
    kind = df.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if made is None or not len(made.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    k = len(made.eigenvalues)
    n, sums, error = made.n, made.sums, made.identity_error
    scale, shares = made.components.T / np.sqrt(made.eigenvalues), made.eigenvalues / made.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                rows = matrix(part.column("x"), np.int64)
                away = _deviations(rows, n, sums)
                if int(np.abs(away).max(initial=0)) ** 2 * rows.shape[1] >= 1 << 63:
                    away = away.astype(object)
                square = [int(s) if s < 1 << 63 else None for s in (away * away).sum(axis=1).tolist()]
                white = (away.astype(np.float64) / n) @ scale
                m = len(rows)
                at = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    one_array(part.column("vec_id")).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n), pa.int64()), pa.array(square, pa.int64()).take(pa.array(at)),
                    pa.array(white.reshape(-1)), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
