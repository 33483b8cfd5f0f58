"""Numpy helpers for Arrow columns and exact distances of row pairs."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

PAIR_SLICE = 1 << 17      # pairs re-scored at a time
SCORE_CELLS = 1 << 21     # entries of one score matrix


def one_array(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column


def matrix(column, dtype=np.float64) -> np.ndarray:
    """Rows of a fixed-width list column as a 2-d array."""
    column = one_array(column)
    n = len(column)
    if n == 0:
        return np.empty((0, 0), dtype)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(n, -1)


def longs(column) -> np.ndarray:
    return one_array(column).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def list_column(rows: np.ndarray, value_type: pa.DataType) -> pa.ListArray:
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1), type=value_type)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def pair_distance(metric: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distance of row i of ``left`` to row i of ``right``; the same bits wherever the pair is met."""
    if metric == "l2":
        diff = left - right
        return np.einsum("ij,ij->i", diff, diff)
    dot = np.einsum("ij,ij->i", left, right)
    if metric == "mips":
        return -dot
    if metric == "cosine":
        norms = np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(norms > 0, 1.0 - dot / norms, np.nan)
    raise ValueError(f"unknown metric {metric!r}")


def rank_in_group(group: np.ndarray) -> np.ndarray:
    """0-based position inside runs of equal values of a sorted array."""
    n = len(group)
    if n == 0:
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))


def _at_most(scores: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the finite scores that are at most the limit of their row, by row."""
    limit = np.fmin(limit, np.finfo(scores.dtype).max).astype(scores.dtype)
    at = np.flatnonzero((scores <= limit[:, None]).reshape(-1))
    qi, bi = np.divmod(at, max(1, scores.shape[1]))
    finite = scores[qi, bi] > -np.inf
    return (qi, bi) if finite.all() else (qi[finite], bi[finite])


def kth_bound(scores: np.ndarray, k: int) -> np.ndarray:
    """An upper bound of the k-th smallest score of each row: the k-th smallest of the least of disjoint groups."""
    k = min(k, scores.shape[1])
    fold = min(16, scores.shape[1] // (4 * k))
    if fold > 1:
        width = scores.shape[1] // fold
        least = scores[:, :width].copy()
        for n in range(1, fold):
            np.fmin(least, scores[:, n * width:(n + 1) * width], out=least)
        kth = np.partition(least, k - 1, axis=1)[:, k - 1]
        if not np.isnan(kth).any():
            return kth
    return np.partition(scores, k - 1, axis=1)[:, k - 1]


def rounded_within(d: float, radius: float, digits: int) -> bool:
    """Whether ``d``, rounded half up to ``digits`` decimals as Spark and SQL do, is at most ``radius``."""
    return float(Decimal(repr(float(d))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) <= radius


class Block:
    """One block of base rows prepared for scoring against queries.

    Scores in single precision, with a bound of their error, leave few pairs to be scored exactly. Values beyond its
    range, or scores too close to each other for it, are left to double precision.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, metric: str):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.metric = ids[order], rows[order], metric
        self.sq = np.einsum("ij,ij->i", self.rows, self.rows)
        self.top = self.sq.max(initial=0.0)
        self._right = None

    def rough(self, q: np.ndarray):
        """Score matrix by matrix product, and a bound of its rounding error per query."""
        q_sq = np.einsum("ij,ij->i", q, q)
        dots = q @ self.rows.T
        if self.metric == "l2":
            return q_sq[:, None] + self.sq[None, :] - 2.0 * dots, 1e-12 * q.shape[1] * (q_sq + self.top + 1e-30)
        if self.metric == "mips":
            return -dots, 1e-13 * q.shape[1] * (np.sqrt(q_sq * self.top) + 1e-30)
        norms = np.sqrt(q_sq[:, None] * self.sq[None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.where(norms > 0, 1.0 - dots / norms, np.inf)
        return scores, np.full(len(q), 1e-12 * q.shape[1])

    def _prepared(self):
        """Middle, transposed single-precision rows and largest squared norm that ``rough32`` multiplies with."""
        if self._right is None:
            middle = self.rows.mean(axis=0) if self.metric == "l2" else np.zeros(self.rows.shape[1])
            x = self.rows - middle
            sq = np.einsum("ij,ij->i", x, x)
            if self.metric == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = x / np.sqrt(sq)[:, None]
                right = -x
            else:
                right = np.c_[-2.0 * x, sq] if self.metric == "l2" else -x
            self._right = middle, np.ascontiguousarray(right.T, np.float32), sq.max(initial=0.0)
        return self._right

    def rough32(self, q: np.ndarray):
        """As ``rough`` in single precision, less a part that is the same for a whole row; scores, slack, that part.

        None where single precision does not reach.
        """
        if not self.top < 1e20 or (self.metric == "cosine" and not self.sq.min(initial=1.0) > 1e-20):
            return None
        middle, right, top = self._prepared()
        shifted = q - middle
        q_sq = np.einsum("ij,ij->i", shifted, shifted)
        if not np.all(q_sq < 1e20) or (self.metric == "cosine" and not np.all(q_sq > 1e-20)):
            return None
        unit = 1.2e-7 * (q.shape[1] + 8)  # twice the rounding error of a product of so many terms, of its factors and of its sum
        if self.metric == "l2":
            return np.c_[shifted, np.ones(len(q))].astype(np.float32) @ right, unit * (q_sq + 2 * top + 1e-30), q_sq
        if self.metric == "mips":
            return shifted.astype(np.float32) @ right, unit * (np.sqrt(q_sq * top) + 1e-30), np.zeros(len(q))
        return (shifted / np.sqrt(q_sq)[:, None]).astype(np.float32) @ right, np.full(len(q), 2 * unit), np.ones(len(q))

    def _exact(self, q: np.ndarray, qi: np.ndarray, bi: np.ndarray) -> np.ndarray:
        parts = [
            pair_distance(self.metric, q[qi[s:s + PAIR_SLICE]], self.rows[bi[s:s + PAIR_SLICE]])
            for s in range(0, len(qi), PAIR_SLICE)
        ]
        return np.concatenate(parts) if parts else np.empty(0)

    def _hide_same(self, scores: np.ndarray, q_ids: np.ndarray) -> None:
        first, last = (np.searchsorted(self.ids, q_ids, side) for side in ("left", "right"))
        for n in np.flatnonzero(last > first):
            scores[n, first[n]] = np.inf

    def _chunks(self, q_ids: np.ndarray, q: np.ndarray, skip_same: bool):
        """Scores of some queries, slack, the part to add, and a function that gives them in double precision."""
        step = max(1, SCORE_CELLS // max(1, len(self.ids)))
        for s in range(0, len(q_ids), step):
            rows = q[s:s + step]

            def double(rows=rows, s=s):
                scores, slack = self.rough(rows)
                if skip_same:
                    self._hide_same(scores, q_ids[s:s + step])
                return scores, slack, np.zeros(len(rows))

            found = self.rough32(rows)
            if found is None:
                found, double = double(), None
            elif skip_same:
                self._hide_same(found[0], q_ids[s:s + step])
            yield s, rows, found, double

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, skip_same: bool = False):
        """(query index, base index, distance) of the k best per query, ordered by (distance, id)."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

        def close(scores, slack, _):
            kth = kth_bound(scores, k)
            return _at_most(scores, np.where(np.isnan(kth), -np.inf, kth + 2 * slack))

        if len(self.ids) and len(q_ids):
            for s, rows, found, double in self._chunks(q_ids, q, skip_same):
                qi, bi = close(*found)
                if double is not None and len(qi) > len(rows) * (8 * k + len(self.ids) // 8):
                    qi, bi = close(*double())
                d = self._exact(rows, qi, bi)
                order = np.lexsort((self.ids[bi], d, qi))
                qi, bi, d = qi[order], bi[order], d[order]
                best = rank_in_group(qi) < k
                out.append((qi[best] + s, bi[best], d[best]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def within(self, q_ids: np.ndarray, q: np.ndarray, radius: float, skip_same: bool = False):
        """All pairs with distance <= radius."""
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *self.within_parts(q_ids, q, radius, skip_same)]
        return tuple(np.concatenate(c) for c in zip(*parts))

    def within_parts(self, q_ids: np.ndarray, q: np.ndarray, radius, skip_same: bool = False):
        """The pairs of ``within`` part by part, at most SCORE_CELLS, or those of one query; a radius for all or one for each."""
        radius = np.broadcast_to(np.asarray(radius, float), len(q_ids))
        if len(self.ids) and len(q_ids):
            for s, rows, (scores, slack, part), _ in self._chunks(q_ids, q, skip_same):
                limit = radius[s:s + len(rows)]
                qi, bi = _at_most(scores, limit + 2 * slack - part)
                d = self._exact(rows, qi, bi)
                hit = d <= limit[qi]
                yield qi[hit] + s, bi[hit], d[hit]

    def count_within(self, q_ids: np.ndarray, q: np.ndarray, radius: float, digits: int, skip_same: bool = False) -> np.ndarray:
        """Per query the rows whose distance, rounded to ``digits`` decimals, is at most ``radius``.

        Only pairs that a score cannot decide are scored exactly, so hits take no memory.
        """
        n, grain = np.zeros(len(q_ids), np.int64), 10.0 ** -digits
        if len(self.ids) and len(q_ids):
            for s, rows, (scores, slack, part), _ in self._chunks(q_ids, q, skip_same):
                middle, width = radius - part, 2 * slack + grain
                sure = (scores < (middle - width).astype(scores.dtype)[:, None]) & (scores > -np.inf)
                counted = np.count_nonzero(sure, axis=1)
                scores[sure] = np.inf
                qi, bi = _at_most(scores, middle + width)
                d = self._exact(rows, qi, bi)
                hit = d <= radius + 0.4 * grain
                for k in np.flatnonzero(~hit & (d <= radius + 0.6 * grain)):
                    hit[k] = rounded_within(d[k], radius, digits)
                n[s:s + len(rows)] = counted + np.bincount(qi[hit], minlength=len(rows))
        return n


def add_exact(at: np.ndarray, n: int, rows: np.ndarray):
    """Sums and counts of rows per key 0..n-1."""
    sums = np.zeros((n, rows.shape[1]))
    np.add.at(sums, at, rows)
    return sums, np.bincount(at, minlength=n)
