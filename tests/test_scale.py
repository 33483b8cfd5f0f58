"""Kernels and reports that must neither make all pairs nor make their input twice."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.operators import evaluate, pruned, search
from vecloom.operators.ranges import range_join
from vecloom.plans import arrays, blocks
from vecloom.plans.arrays import Block, pair_distance


def counted(df, spark):
    """``df`` and an accumulator of how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_single_precision_keeps_the_exact_answers(metric, shift):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 9)) + shift
    x[100:140] = x[7]
    block = Block(np.arange(700), x, metric)
    qi, bi, d = block.nearest(np.arange(60), x[:60], 12, skip_same=True)
    for q in range(60):
        want = pair_distance(metric, x, np.repeat(x[q][None], 700, 0))
        best = [i for _, i in sorted((v, i) for i, v in enumerate(want) if i != q)][:12]
        assert bi[qi == q].tolist() == best
        assert d[qi == q].tolist() == want[best].tolist()


def test_range_counts_are_those_of_the_pairs(spark, points):
    df, x, _ = points
    asked = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    radius = float(np.round(pair_distance("l2", x[200:201], x[210:211])[0], 3))  # many distances are near it
    pairs = range_join(df, asked, radius + 1e-3, skip_same=True).where(F.round("dist", 3) <= radius)
    want = {r.qid: r.n for r in pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.qid: r.hits for r in range_join(df, asked, radius, skip_same=True, counted=3).collect()}
    assert want and got == want


def test_reports_make_their_rows_once(spark):
    rows = spark.range(200).selectExpr("id % 20 AS qid", "id", "CAST(id DIV 20 + 1 AS INT) AS rank", "CAST(id DIV 20 AS DOUBLE) AS dist")
    for report in (
        lambda t: evaluate.recall(rows, t, 5), lambda t: evaluate.recall_curve(rows, t, 5),
        lambda t: evaluate.query_stats(t.select("dist", "rank"), ["dist", "rank"], [0.5])):
        truth, made = counted(rows, spark)
        assert report(truth).count()
        assert made.value == 200


def test_range_recall_counts_each_pair_once(spark):
    rows = lambda pairs: spark.createDataFrame(pairs, "qid long, id long")
    truth, found = rows([(1, 5), (1, 5), (1, 6), (2, 5)]), rows([(1, 5), (1, 5), (1, 9), (3, 1)])
    got = evaluate.range_recall(found, truth, spark.createDataFrame([(1,), (2,), (3,)], "qid long")).first()
    assert (got.range_recall, got.n_queries) == (50.0, 3)


def test_neighbours_of_many_points_at_once():
    index = search._Index(np.array([2, 4, 9]), pa.array([[0.0]] * 3), np.array([0, 2, 2, 3]), np.array([1, 2, 0]), None)
    owner, at = index.around(np.array([0, 0, 1, 1]), np.array([9, 2, 4, 5]))
    assert sorted(zip(owner.tolist(), at.tolist())) == [(0, 0), (0, 1), (0, 2)]


def test_newest_rows_of_a_batch(spark):
    """Only the window's rows are placed, ties at its edge included; places are those among all rows."""
    from vecloom.streaming.live_graph import _newest
    rows = [(None if n < 2 else n // 4, n, [float(n)], ["x"]) for n in range(400)]
    df = spark.createDataFrame(rows, "ts long, tag long, vec array<double>, labels array<string>").repartition(5)
    for window, kept in ((30, 30), (1, 1), (400, 400), (1000, 400), (399, 399)):
        got = sorted((r.seq, r.tag) for r in _newest(df, 400, window).collect())
        assert got == [(n, n) for n in range(400 - kept, 400)]


def test_a_query_meets_reached_rings_only(spark, monkeypatch):
    """Around one centre a query with a small ball meets the few rows at its own distance, and loses none."""
    from vecloom.operators import ranges
    met = []
    cells = ranges.cell_pairs

    def counted(base, queries, *args, by, **options):
        met.append(base.groupBy(by).count().join(queries, by).agg(F.sum("count")).first()[0])
        return cells(base, queries, *args, by=by, **options)

    monkeypatch.setattr(ranges, "cell_pairs", counted)
    df = spark.createDataFrame([(n, [n / 10, 0.0]) for n in range(200)], "id long, vec array<double>")
    center = spark.createDataFrame([(5, [0.0, 0.0])], "cid long, vec array<double>")
    got = range_join(df, df.toDF("qid", "qvec"), 0.25 + 1e-9, centers=center).collect()
    assert len(got) == sum(abs(a - b) <= 5 for a in range(200) for b in range(200))
    assert met[0] < 0.3 * 200 * 200


def test_hits_of_a_range_join_leave_in_parts(spark, points, monkeypatch):
    """A wide ball holds every pair: the hits of a cell are never one table."""
    df, x, _ = points
    df, ids = df.select("id", "vec"), np.arange(300)
    monkeypatch.setattr(arrays, "SCORE_CELLS", 2_000)
    block = Block(ids, x, "l2")
    parts = list(block.within_parts(ids, x, 1e9, skip_same=True))
    assert len(parts) == 50 and max(len(d) for *_, d in parts) <= 2_000
    assert sum(len(d) for *_, d in parts) == len(block.within(ids, x, 1e9, skip_same=True)[2]) == 300 * 299
    assert sum(len(d) for *_, d in block.within_parts(ids, x, np.where(ids < 2, 1e9, -1.0))) == 2 * 300
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 0)
    found = range_join(df, df.toDF("qid", "qvec"), 1e9, skip_same=True)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 300 * 299


def test_pruned_neighbours_move_no_vectors_that_fit(spark, points, monkeypatch):
    df = points[0].select("id", "vec")
    asked = df.toDF("qid", "qvec")
    scored, cells = [], pruned.cell_pairs
    monkeypatch.setattr(pruned, "cell_pairs", lambda *a, **o: (scored.append(1), cells(*a, **o))[1])
    runs = []
    for fits in (True, False):
        if not fits:
            monkeypatch.setattr(pruned, "fetch_held", lambda *_: None)
        for k, skip in ((1, False), (7, True), (400, True)):
            found, work = pruned.pruned_knn(df, asked, k, skip_same=skip)
            runs.append((sorted(map(tuple, found.collect())), work.first()))
        assert len(scored) == (0 if fits else 6)
    assert runs[:3] == runs[3:]
    twice = pruned.pruned_knn(df.unionByName(df.where("id < 5")), asked, 3)[0]  # ids that repeat travel as before
    assert len(scored) == 8 and twice.count() == 3 * df.count()
