import numpy as np
import pytest

from vecloom.functions.precision import _bf16
from vecloom.operators.prune import _prune_one
from vecloom.plans.arrays import Block, pair_distance, rank_in_group


def brute(metric, q, b):
    if metric == "l2":
        return ((q[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    dot = q @ b.T
    if metric == "mips":
        return -dot
    return 1 - dot / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(b, axis=1))


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
def test_nearest_breaks_ties_by_id(metric):
    rng = np.random.default_rng(0)
    b = rng.integers(-2, 3, size=(200, 4)).astype(float)
    b[np.abs(b).sum(1) == 0] = 1
    q = rng.integers(-2, 3, size=(30, 4)).astype(float)
    q[np.abs(q).sum(1) == 0] = 1
    ids = rng.permutation(1000)[:200]
    block = Block(ids, b, metric)
    qi, bi, d = block.nearest(np.arange(30), q, 7)
    full = brute(metric, q, b)
    for i in range(30):
        exact = pair_distance(metric, np.repeat(q[i:i + 1], 200, 0), b)
        want = sorted(zip(exact, ids))[:7]
        got = list(zip(d[qi == i], block.ids[bi[qi == i]]))
        assert [g[1] for g in got] == [w[1] for w in want]
        assert np.allclose(sorted(full[i])[:7], [g[0] for g in got])


def test_zero_vectors_have_no_cosine():
    block = Block(np.array([1, 2]), np.array([[0.0, 0.0], [1.0, 0.0]]), "cosine")
    qi, bi, d = block.nearest(np.array([5]), np.array([[1.0, 1.0]]), 2)
    assert block.ids[bi].tolist() == [2]


def test_within_equals_brute_force():
    rng = np.random.default_rng(1)
    b, q = rng.normal(size=(90, 6)), rng.normal(size=(40, 6))
    block = Block(np.arange(90), b, "l2")
    qi, bi, _ = block.within(np.arange(40), q, 5.0)
    want = np.argwhere(brute("l2", q, b) <= 5.0)
    assert sorted(zip(qi, bi)) == [tuple(x) for x in want]


def naive_prune(d, x, R, alpha, metric, labels=None):
    """Candidate by candidate, with a plain list of hidden marks."""
    hidden, out, level = [0.0] * len(d), [], np.float32(1)
    while level <= np.float32(alpha) and len(out) < R:
        for c in range(len(d)):
            if len(out) >= R:
                break
            if hidden[c] > level:
                continue
            hidden[c] = float("inf")
            out.append(c)
            for j in range(c + 1, len(d)):
                if hidden[j] > alpha or (labels is not None and not set(labels[j]) <= set(labels[c])):
                    continue
                between = pair_distance(metric, x[j:j + 1], x[c:c + 1])[0]
                if metric == "mips":
                    if -between > level * -d[j]:
                        hidden[j] = max(hidden[j], level + np.float32(0.01))
                else:
                    hidden[j] = float("inf") if between == 0 else max(hidden[j], np.float32(d[j] / between))
        level = np.float32(level * np.float32(1.2))
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
@pytest.mark.parametrize("guarded", [False, True])
def test_prune_equals_plain_loops(metric, guarded):
    rng = np.random.default_rng(3)
    for trial in range(25):
        n = int(rng.integers(1, 40))
        x = rng.normal(size=(n, 5))
        x[rng.integers(0, n, n // 4)] = x[0]
        p = rng.normal(size=5)
        d = pair_distance(metric, x, np.repeat(p[None], n, 0))
        order = np.argsort(d, kind="stable")
        d, x = d[order], x[order]
        labels = [{int(v) for v in rng.integers(0, 3, rng.integers(1, 3))} for _ in range(n)] if guarded else None
        R = int(rng.integers(1, 12))
        got = sorted(_prune_one(d, x, R, np.float32(1.2), metric, labels).tolist())
        assert got == naive_prune(d, x, R, 1.2, metric, labels)


def test_rank_in_group():
    assert rank_in_group(np.array([3, 3, 5, 5, 5, 9])).tolist() == [0, 1, 0, 1, 2, 0]


def test_bf16_rounds_to_even():
    x = np.array([1.0, 1.00390625, 3.1415927, -2.7182817], np.float32)
    y = _bf16(x)
    assert y[0] == 1.0 and (np.abs(y - x) <= np.abs(x) * 2 ** -8).all()
    assert ((y.view(np.uint32) & 0xFFFF) == 0).all()
