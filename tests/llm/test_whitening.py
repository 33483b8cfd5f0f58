import math
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x array<long>, n int, component string"


def table(spark, rows):
    full = [(i, v, [1], 2, "c") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)


def plain(rows, wanted=16):
    """Covariance and its eigenvectors in one place, with whole numbers as far as they go."""
    whole = lambda c: math.floor(max(min(64.0 * c, 2.0**46), -2.0**46)) + 1_000_000
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in good)
    dim = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    kept = [(i, tuple(whole(float(np.float32(c))) for c in v)) for i, v in good if len(v) == dim]
    fit = sorted(set(x for _, x in kept))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit]).reshape(n, dim)
    values, vectors = np.linalg.eigh(x.T @ x / n) if n and dim else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [j for j in range(min(wanted, dim)) if values[j] > 1e-14 * max(values[0], 1e-300) and values[0] > 0]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(row, sums)) for i, row in kept}
    return kept, n, sums, values, vectors, keep, deviation


def got(spark, rows, **options):
    return whitening.whiten(table(spark, rows), **options).collect()


def agree(spark, rows, distinct=True):
    kept, n, sums, values, vectors, keep, deviation = plain(rows)
    out = got(spark, rows)
    assert len(out) == len(kept) * len(keep)
    trace = values.sum()
    for r in out:
        assert r.n == n and r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None)
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained
        assert r.identity_error <= 1e-8
    if distinct:
        for j in keep:
            mine = {r.vec_id: r.whitened for r in out if r.component == j + 1}
            want = {i: (np.array([float(n * a - s) / n for a, s in zip(row, sums)]) @ vectors[:, j]) / np.sqrt(values[j]) for i, row in kept}
            sign = np.sign(sum(mine[i] * want[i] for i in mine))
            assert max(abs(mine[i] * sign - want[i]) for i in mine) < 1e-7
    return out


def normal(n, dim, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) * np.linspace(3, 0.2, dim)).tolist()


def test_whitening(spark):
    """Copies, nulls, bad entries, other lengths, repeated ids and a missing id."""
    rows = list(enumerate(normal(300, 20, 1)))
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(5, rows[5][1])]
    rows += [(2000, None), (2001, [None] + [0.1] * 19), (2002, [float("nan")] + [0.1] * 19), (2003, [float("inf")] * 20), (2004, [1.0]), (2005, [])]
    agree(spark, rows)
    nameless = got(spark, [(None, v) for _, v in rows[:30]])
    assert len(nameless) == 30 * 16 and nameless[0].vec_id is None


def test_few_directions(spark):
    """Fewer directions than components, and a constant dimension."""
    rng = np.random.default_rng(3)
    flat = rng.integers(-3, 4, size=(80, 3)) @ np.array([[1, 0, 2, 0, 1], [0, 1, 0, 0, 3], [1, 1, 0, 0, 0]])
    out = agree(spark, list(enumerate(flat.astype(float).tolist())))
    assert {r.component for r in out} == {1, 2, 3}


def test_repeated_deviations(spark):
    """Directions that differ equally: one start vector alone would meet one direction of each deviation."""
    rows = [(2 * d + s, [(-1.0) ** s * (2 if d < 4 else 1) if i == d else 0.0 for i in range(8)]) for d in range(8) for s in (0, 1)]
    out = agree(spark, rows, distinct=False)
    assert {r.component for r in out} == set(range(1, 9))


def test_huge_entries(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3.0, -1e20]), (3, [0.0, 0.0])]
    out = agree(spark, rows, distinct=False)
    assert any(r.deviation is None for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert got(spark, rows) == []


def test_ends_early(spark):
    """With few large deviations the steps end before they fill the space; the answer is the same."""
    rng = np.random.default_rng(5)
    x = np.hstack([rng.normal(size=(400, 2)) * 40, np.round(rng.normal(size=(400, 30)) * 0.01, 3)])
    df = table(spark, list(enumerate(x.tolist())))
    fit, made = whitening.fit_whitening(whitening.whole_vectors(df, "vec_id", "embedding"), 2)
    rows = np.array([r.x for r in fit.collect()], float)
    values = np.linalg.eigvalsh(np.cov(rows.T, bias=True))[::-1]
    assert np.allclose(made.eigenvalues, values[:2], rtol=1e-11) and made.passes < 30


def test_given_table(spark):
    """The registered query's answer over the whole table, against a dense eigendecomposition."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = whitening.whiten(e).where("component IN (1, 7, 16)").collect()
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    kept, n, sums, values, vectors, _, deviation = plain(rows)
    for j in (0, 6, 15):
        mine = {r.vec_id: r for r in out if r.component == j + 1}
        want = {i: (np.array([float(n * a - s) / n for a, s in zip(row, sums)]) @ vectors[:, j]) / np.sqrt(values[j]) for i, row in kept}
        sign = np.sign(sum(mine[i].whitened * want[i] for i in mine))
        assert len(mine) == len(kept) and max(abs(mine[i].whitened * sign - want[i]) for i in mine) < 1e-6
        assert all(mine[i].deviation == deviation[i] for i in mine)
