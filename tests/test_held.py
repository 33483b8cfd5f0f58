"""Vectors that go to the tasks, files read by many small pieces, and rows that are made once."""

import os
import subprocess
import sys
from glob import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_kernels import naive_prune
from test_scale import counted

from vecloom.operators import graph, prune
from vecloom.operators import search
from vecloom.operators.search import graph_search
from vecloom.plans.arrays import pair_distance
from vecloom.plans.held import Shelf, fetch_held, held_matrix, shelved
from vecloom.plans.scratch import shared_dir
from vecloom.sources import buckets, snapshot, truthfiles, vecfiles


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
def test_many_lists_are_pruned_like_each_alone(metric):
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 30, 40)
    group = np.repeat(np.arange(40), sizes)
    x = rng.normal(size=(len(group), 5))
    x[rng.integers(0, len(x), 200)] = x[0]
    d = pair_distance(metric, x, np.repeat(rng.normal(size=(1, 5)), len(x), 0))
    order = np.lexsort((d, group))
    d, x = d[order], x[order]
    labels = [{int(v) for v in rng.choice([0, 1, 64, 65, 130], rng.integers(1, 3))} for _ in group]
    masks = prune.label_masks(pa.array([[*v, *range(200, 330)] for v in labels]))  # three words
    assert masks.shape[1] > 1
    got = prune._prune_lists(group, d, x, 6, np.float32(1.2), metric, masks)
    for n in range(40):
        mine = np.flatnonzero(group == n)
        want = naive_prune(d[mine], x[mine], 6, 1.2, metric, [labels[i] for i in mine])
        assert np.flatnonzero(got[mine]).tolist() == want


@pytest.mark.parametrize("options", [{}, {"guard": True}, {"saturate": True}])
def test_pruning_joins_no_vectors_that_fit(spark, points, monkeypatch, options):
    df, _, _ = points
    asked = df.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    from vecloom.operators.knn import exact_knn
    candidates = exact_knn(df, asked, 30, skip_same=True).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")
    candidates = candidates.unionByName(candidates.limit(50)).unionByName(candidates.limit(5).withColumn("dst", F.lit(10**9)))
    held = prune.robust_prune(candidates, df, 6, **options)
    assert "Join" not in held._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(prune, "fetch_held", lambda *_: None)
    joined = prune.robust_prune(candidates, df, 6, **options)
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, joined.collect()))


def test_repeated_ids_are_joined(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (2, [5.0])], "id long, vec array<double>")
    candidates = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, dist double")
    assert prune._held(rows, False) is None
    assert prune.robust_prune(candidates, rows, 2, saturate=True).count() == 2


def test_a_walk_in_tasks_keeps_its_lists_alone(spark, points):
    df, _, _ = points
    edges = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("dist"))
    asked = df.where("id < 9").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    walk = graph_search(edges, df, asked, df.where("id = 0").select("id"), 5, 12)
    assert not {"seen", "qvec", "marks", "chosen"} & set(walk.state.columns)
    assert walk.results(5).count() == 45


def test_of_rows_that_share_a_qid_one_walks(spark, points):
    df, _, _ = points
    edges = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("dist"))
    asked = df.where("id < 9").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    walk = graph_search(edges, df, asked.unionByName(asked.where("id < 3")), df.where("id = 0").select("id"), 5, 12)
    rows = walk.stats.collect()
    assert len(rows) > 9 and sorted(r.qid for r in rows if r.n_hops) == list(range(9))


def test_walks_need_no_package_on_the_workers(tmp_path):
    """The index travels as plain arrays, as everything else does."""
    script = tmp_path / "walk.py"
    root = os.path.dirname(os.path.dirname(os.path.abspath(graph.__file__)))
    script.write_text(f'''
import sys
sys.path.insert(0, {os.path.dirname(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setCheckpointDir({str(tmp_path)!r})
from vecloom.operators import search
from vecloom.operators.search import graph_search
points = spark.createDataFrame([(n, [float(n)]) for n in range(20)], "id long, vec array<double>")
edges = spark.createDataFrame([(n, n + 1, 1.0) for n in range(19)], "src long, dst long, dist double")
asked = points.where("id = 7").selectExpr("id AS qid", "vec AS qvec")
print("FOUND", graph_search(edges, points, asked, points.where("id = 0").select("id"), 1, 4).results(1).first().id)
''')
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "FOUND 7" in done.stdout, done.stderr[-2000:]


def test_range_truth_of_many_files_is_one_plan(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "range")
    queries = spark.range(60).select(F.col("id").alias("qid"))
    pairs = spark.range(60).where("id % 4 <> 1").selectExpr("id AS qid", "explode(sequence(0L, id)) AS id").withColumn("dist", -F.col("id") * 1.0)
    want = sorted((q, q - i, i) for q in range(60) if q % 4 != 1 for i in range(q + 1))
    for per_file in (2, 1_000):
        for block in (1 << 20, 7):
            monkeypatch.setattr(truthfiles, "BLOCK", block)
            monkeypatch.setattr(truthfiles, "COUNT_BLOCK", 65_536 if block > 7 else 5)
            if block > 7:
                truthfiles.write_range_truth(pairs, queries, f"{path}-{per_file}", queries_per_file=per_file)
            back = truthfiles.read_range_truth(spark, f"{path}-{per_file}")
            assert "Union" not in back._jdf.queryExecution().optimizedPlan().toString()
            assert sorted((r.qid, r.pos, r.id) for r in back.collect()) == want


def test_truth_is_read_without_a_join(spark, tmp_path):
    path = str(tmp_path / "truth")
    truth = spark.range(90).selectExpr("id DIV 3 AS qid", "CAST(id % 3 + 1 AS INT) AS rank", "id * 7 AS id", "CAST(id AS DOUBLE) AS dist")
    truthfiles.write_truth(truth, path, queries_per_file=4)
    back = truthfiles.read_truth(spark, path)
    assert "Join" not in back._jdf.queryExecution().optimizedPlan().toString()
    assert back.exceptAll(truth).isEmpty() and back.count() == 90


def test_files_make_their_rows_once(spark, tmp_path):
    rows = spark.range(200).selectExpr("id DIV 10 AS qid", "id", "CAST(id % 10 + 1 AS INT) AS rank", "CAST(id AS DOUBLE) AS dist", "array(CAST(id AS FLOAT)) AS vec")
    queries = spark.range(20).select(F.col("id").alias("qid"))
    for n, write in enumerate((
            lambda t, p: truthfiles.write_truth(t, p, queries_per_file=3),
            lambda t, p: truthfiles.write_range_truth(t, queries, p, queries_per_file=3),
            lambda t, p: vecfiles.write_vectors(t, p, "fvecs", rows_per_file=30))):
        once, made = counted(rows, spark)
        write(once, str(tmp_path / f"out-{n}"))
        assert made.value == 200


def test_very_many_buckets_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FOLDERS", 4)
    path, rows = str(tmp_path / "delta"), spark.range(60).selectExpr("id", "id * 2 AS x")
    first = snapshot.save_delta_snapshot(spark, path, 0, {"t": ("id", rows)}, buckets=50)
    changed = rows.withColumn("x", F.when(F.col("id") == 7, -1).otherwise(F.col("x"))).where("id <> 9")
    second = snapshot.save_delta_snapshot(spark, path, 1, {"t": ("id", changed)}, buckets=50)
    assert second["t"] <= 2 < first["t"] <= 50
    for version, want in ((0, rows), (1, changed)):
        got = snapshot.load_delta_snapshot(spark, path, version)["t"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for gen in glob(f"{path}/t/gen=*"):
        assert len(glob(f"{gen}/bucket=*")) <= 4
    table = buckets.BucketTable(spark, str(tmp_path / "merged"), "id", "id long, x long", 50)
    gens = table.merge([buckets.EMPTY] * 50, 0, rows)
    gens = table.merge(gens, 1, rows.where("id = 3").withColumn("x", F.lit(5)), rows.where("id IN (4, 5)").select("id"))
    got = {r.id: r.x for r in table.read(gens).collect()}
    assert got == {**{n: 2 * n for n in range(60) if n not in (4, 5)}, 3: 5}
    assert [r.x for r in table.matching(gens, rows.where("id = 3").select("id")).collect()] == [5]


def test_an_index_of_over_a_quarter_million_points_is_still_held(spark):
    rows = spark.range(300_000).select("id", F.array(F.col("id").cast("float")).alias("vec"))
    table, order = fetch_held(rows, "vec")
    assert table.num_rows == len(order) == 300_000


def test_an_index_is_the_same_however_many_lists_are_read_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(search, "LISTS", 7)
    nodes = spark.range(40).select("id", F.array(F.col("id").cast("float")).alias("payload")).repartition(5)
    rows = [(s, [(s * k + 1) % 50 for k in range(s % 4)]) for s in [*range(45), 3, 11]]  # unknown ends and starts, two lists of one point
    path, carriers = search._held_index(spark.createDataFrame(rows, "src long, nbrs array<long>").coalesce(1), nodes, False, 1000)
    arrays = shelved(path)
    assert carriers is None and arrays["ids"].tolist() == list(range(40)) and arrays["payload"].ravel().tolist() == list(range(40))
    for n in range(40):
        got = arrays["nbrs"][arrays["offsets"][n]:arrays["offsets"][n + 1]].tolist()
        assert got == [d for s, nbrs in rows if s == n for d in nbrs if d < 40]


def test_a_walk_leaves_no_index_behind(spark, points):
    df, _, _ = points
    edges = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("dist"))
    asked = df.where("id < 3").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    kept = f"{shared_dir(spark).removeprefix('file:')}/index-*"
    before = glob(kept)
    assert graph_search(edges, df, asked, df.where("id = 0").select("id"), 5, 12).results(5).count() == 15
    assert glob(kept) == before


def test_a_shelf_keeps_types_and_missing_values(spark):
    shelf = Shelf(spark)
    column = pa.chunked_array([pa.array([[1, 2], [3, 4]], pa.list_(pa.int8())), pa.array([[5, None]], pa.list_(pa.int8()))])
    assert held_matrix(shelf, "whole", column.slice(0, 2), np.array([1, 0])).dtype == np.int8
    held_matrix(shelf, "gap", column, np.array([2, 0, 1]))
    assert held_matrix(shelf, "ragged", pa.chunked_array([pa.array([[1.0], [1.0, 2.0]])]), np.arange(2)) is None
    arrays = shelved(shelf.close())
    assert arrays["whole"].tolist() == [[3, 4], [1, 2]]
    assert np.array_equal(arrays["gap"], [[5, np.nan], [1, 2], [3, 4]], equal_nan=True)
