import os
import subprocess
import sys

import numpy as np
import pytest

from vecloom.operators import pq

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)) + 3.0
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "id long, vec array<double>")
    quantizer = pq.pq_train(rows, 3, centers=8)
    turn = np.roll(np.eye(6), 1, axis=1)
    quantizer.rotation = spark.createDataFrame([(n, r) for n, r in enumerate(turn.tolist())], "row int, vec array<double>")
    codes = pq.pq_encode(rows, quantizer).cache()
    near = np.array([r.vec for r in pq.pq_decode(codes, quantizer).orderBy("id").collect()])
    return rows.selectExpr("id AS qid", "vec AS qvec").where("qid < 5"), codes, quantizer, x, near


@pytest.mark.parametrize("metric", ["l2", "mips"])
def test_a_rotated_quantizer_ranks_like_its_restored_vectors(world, metric):
    queries, codes, quantizer, x, near = world
    found = pq.adc_scan(queries, codes, quantizer, 60, metric).orderBy("qid", "rank").collect()
    for q in range(5):
        true = ((x[q] - near) ** 2).sum(1) if metric == "l2" else -near @ x[q]
        got = [r.id for r in found if r.qid == q]
        assert len(got) == 60 and np.all(np.diff(true[got]) > -1e-9)


def test_workers_need_no_copy_of_the_package(tmp_path):
    script = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from vecloom.operators import pq\n"
        "rows = spark.range(40).selectExpr('id', 'array(double(id), double(id % 7), 1D, double(id % 3)) AS vec')\n"
        "q = pq.pq_train(rows, 2, centers=4)\n"
        "codes = pq.pq_encode(rows, q)\n"
        "asked = rows.selectExpr('id AS qid', 'vec AS qvec').where('qid < 3')\n"
        "assert pq.adc_scan(asked, codes, q, 2).count() == 6\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_training_on_all_rows(spark, points):
    """A step equals plain numpy, errors fall, copies make fewer centres, runs repeat, and cuts of the table do not matter."""
    from vecloom.operators import pq_all
    df, x, _ = points
    rows = df.select("id", "vec")
    book, errors = pq_all.pq_train_all(rows, 3, centers=8, reps=3)
    assert all(b <= a for a, b in zip(errors, errors[1:]))
    again, _ = pq_all.pq_train_all(rows.repartition(9), 3, centers=8, reps=3)
    for a, b in zip(book.arrays().books, again.arrays().books):
        assert a.shape == b.shape and np.allclose(a, b, atol=1e-9)
    known = book.arrays()
    sums = {(r.chunk, r.code): (r.n, np.array(r.sums)) for r in pq_all.chunk_sums(rows, book).collect()}
    moved = x - x.mean(axis=0)
    for c, ((lo, hi), centers) in enumerate(zip(known.bounds, known.books)):
        near = ((moved[:, None, lo:hi] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for code in range(len(centers)):
            n = int((near == code).sum())
            if n:
                assert sums[(c, code)][0] == n and np.allclose(sums[(c, code)][1], moved[near == code, lo:hi].sum(axis=0), atol=1e-9)
            else:
                assert (c, code) not in sums
    one, _ = pq_all.pq_train_all(rows.where("id < 100"), 3, centers=8, reps=3)
    assert [len(b) for b in one.arrays().books] == [1, 1, 1]
    with pytest.raises(ValueError):
        pq_all.pq_train_all(rows.limit(0), 3)


def test_a_chunk_is_trained_in_little_more_than_its_rows():
    import tracemalloc
    x = np.random.default_rng(2).normal(size=(200_000, 8)).round(2)
    tracemalloc.start()
    try:
        out = pq._seeded_lloyd(x, 4, 2, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.shape == (4, 8) and peak < 1.5 * x.nbytes
