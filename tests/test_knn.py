import numpy as np
import pytest
from pyspark.sql import functions as F

import vecloom.plans.blocks as blocks
from vecloom.operators import knn
from vecloom.operators.ranges import range_join
from vecloom.operators.shards import assign_centers, ivf_search, shard_points, shard_vectors
from vecloom.plans.arrays import pair_distance
from vecloom.plans.blocks import cell_pairs

SOME = [0, 5, 50, 107, 150, 199, 222, 299]


def want(x, ids, q, k, metric="l2", skip=None):
    d = pair_distance(metric, x[ids], np.repeat(q[None], len(ids), 0))
    return [i for _, i in sorted((v, i) for v, i in zip(d, ids) if i != skip)][:k]


def asked(df, ids=SOME, label=None):
    cols = [F.col("id").alias("qid"), F.col("vec").alias("qvec")]
    return df.where(F.col("id").isin(ids)).select(*cols, *([label.alias("label")] if label is not None else []))


def lists(results):
    out = {}
    for r in results.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
@pytest.mark.parametrize("sent", [True, False])
def test_exact_knn(points, monkeypatch, metric, sent):
    df, x, _ = points
    if not sent:
        monkeypatch.setattr(blocks, "BROADCAST_ROWS", 2)
    got = lists(knn.exact_knn(df, asked(df), 9, metric, skip_same=True))
    for q in SOME:
        assert got[q] == want(x, list(range(300)), x[q], 9, metric, skip=q)


def test_small_cells_give_the_same(points):
    df, x, _ = points
    pairs = cell_pairs(df.select("id", "vec"), asked(df), "l2", k=11, base_cell=17, query_cell=3)
    got = lists(knn.rank_results(pairs, 11))
    for q in SOME:
        assert got[q] == want(x, list(range(300)), x[q], 11)


def test_hot_label_is_cut_into_cells(points):
    df, x, labels = points
    queries = asked(df, label=F.lit("hot"))
    exploded = df.select("id", "vec", F.explode("labels").alias("label"))
    pairs = cell_pairs(exploded, queries, "l2", k=5, by="label", base_cell=16, query_cell=2)
    got = lists(knn.rank_results(pairs, 5))
    members = [i for i in range(300) if "hot" in labels[i]]
    for q in SOME:
        assert got[q] == want(x, members, x[q], 5)


def test_label_per_query_with_universal(points):
    df, x, labels = points
    queries = asked(df, label=F.col("labels")[0])
    got = lists(knn.exact_knn_by_label(df, queries, 8, universal="all", skip_same=True))
    for q in SOME:
        members = [i for i in range(300) if labels[q][0] in labels[i] or "all" in labels[i]]
        assert got[q] == want(x, members, x[q], 8, skip=q)


def test_fewer_than_k(points):
    df, x, labels = points
    got = lists(knn.exact_knn(df, asked(df), 50, label="all"))
    members = [i for i in range(300) if "all" in labels[i]]
    for q in SOME:
        assert got[q] == want(x, members, x[q], 50) and len(got[q]) == len(members)


def test_hidden_points_go_before_the_cut(points):
    df, x, _ = points
    tags = df.select("id", F.when(F.col("id") < 90, 0).otherwise(F.col("id") + 7).alias("tag"))
    rows = knn.exact_knn(df, asked(df), 12, tags=tags).collect()
    assert all(r.tag == r.id + 7 for r in rows)
    got = {}
    for r in sorted(rows, key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.id)
    for q in SOME:
        assert got[q] == want(x, list(range(90, 300)), x[q], 12)


@pytest.mark.parametrize("metric,radius", [("l2", 9.0), ("cosine", 0.45), ("mips", -4.0)])
def test_range_join_all_ways(points, spark, monkeypatch, metric, radius):
    df, x, _ = points
    centers = spark.createDataFrame([(n, x[n].tolist()) for n in (0, 130, 180, 220, 260)], "cid long, vec array<double>")
    whole = pair_distance(metric, np.repeat(x[SOME], 300, 0), np.tile(x, (len(SOME), 1))).reshape(len(SOME), 300)
    expected = {(SOME[a], int(b)) for a, b in np.argwhere(whole <= radius)}
    for rows, with_centers in ((4096, None), (2, None), (2, centers)):
        monkeypatch.setattr(blocks, "BROADCAST_ROWS", rows)
        got = {(r.qid, r.id) for r in range_join(df, asked(df), radius, metric, centers=with_centers).collect()}
        assert got == expected


def test_centers_by_map_and_by_cells(points, spark, monkeypatch):
    df, x, _ = points
    centers = spark.createDataFrame([(n, x[n].tolist()) for n in range(98, 140)], "cid long, vec array<double>")
    small = {(r.id, r["rank"]): r.cid for r in assign_centers(df, centers, 3).collect()}
    import vecloom.operators.shards as shards
    monkeypatch.setattr(shards, "MAX_SMALL_CENTERS", 3)
    large = {(r.id, r["rank"]): r.cid for r in assign_centers(df, centers, 3).collect()}
    assert small == large and len(small) == 900
    assert [small[(205, r)] for r in (1, 2, 3)] == want(x, list(range(98, 140)), x[205], 3)


def test_ivf_with_all_shards_is_exact(points, spark):
    df, x, _ = points
    centers = spark.createDataFrame([(n, x[n].tolist()) for n in (0, 130, 180, 220, 260)], "cid long, vec array<double>")
    held = shard_vectors(df.select("id", "vec"), shard_points(df, centers, 2))
    got = lists(ivf_search(held, centers, asked(df), 6, nprobe=5))
    for q in SOME:
        assert got[q] == want(x, list(range(300)), x[q], 6)


def test_base_is_not_shuffled_for_few_queries(points):
    df, _, _ = points
    plan = knn.nearest_pairs(df, asked(df), 5, "l2")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0]


@pytest.mark.parametrize("k", [1, 7, 400])
def test_pruned_knn(spark, points, k):
    """The same rows as without pruning, copies and ties included, and fewer pairs where rows are far apart."""
    from vecloom.operators.pruned import pruned_knn
    df, x, _ = points
    wide = df.select("id", F.transform("vec", lambda v: v + (F.col("id") % 5) * 40).alias("vec"))
    asked = wide.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    for skip in (False, True):
        found, work = pruned_knn(wide, asked, k, skip_same=skip)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, knn.exact_knn(wide, asked, k, skip_same=skip).collect()))
        row = work.first()
        assert row.all_pairs == 300 * 100 and (k > 50 or row.scored < 0.5 * row.all_pairs)
    found, work = pruned_knn(wide.limit(0), asked, k) if k == 1 else (asked.limit(0), None)
    assert found.count() == 0


def test_ivf_layout(spark, points, tmp_path):
    """The rows of a search over shards in memory; the fewer shards are visited, the fewer files are opened."""
    from vecloom.operators.shards import ivf_search_pruned, read_ivf, route_queries, write_ivf
    df, x, _ = points
    centers = df.where("id IN (0, 110, 130, 150, 170, 190, 210, 230)").select(F.col("id").alias("cid"), "vec")
    path = str(tmp_path / "ivf")
    write_ivf(df, centers, path, 2)
    held = shard_vectors(df.select("id", "vec"), shard_points(df, centers, 2))
    asked = df.where("id IN (5, 120, 222)").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    opened = []
    for nprobe in (1, 3, 8):
        found = ivf_search_pruned(path, centers, asked, 6, nprobe)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ivf_search(held, centers, asked, 6, nprobe).collect()))
        routed = route_queries(asked, centers, nprobe)
        opened.append(read_ivf(spark, path, routed).select(F.input_file_name()).distinct().count())
    assert opened[0] < opened[1] < opened[2] == read_ivf(spark, path).select(F.input_file_name()).distinct().count()


def test_split_to_budget(spark, points):
    """Every shard fits, with one hot place of copies; equal rows that do not fit are an error."""
    from vecloom.operators.shards import shard_bytes, split_to_budget
    df, _, _ = points
    rows = df.where("id >= 100 OR id < 20")
    centers, estimate, fits = split_to_budget(rows, shard_bytes(60, 12, 8), 8, k_base=1, rate=1.0)
    assert estimate.agg(F.max("estimate")).first()[0] <= 60 and centers.count() >= 4 and fits <= 8
    with pytest.raises(ValueError, match="equal rows"):
        split_to_budget(df.where("id < 100"), shard_bytes(60, 12, 8), 8, k_base=1, rate=1.0)


def test_shards_get_bridges(spark, points, monkeypatch):
    """Also where the middles of the shards are too many to be sent to the tasks."""
    from vecloom.operators import graph, shards
    df, _, _ = points
    shard_map = df.select("id", (F.col("id") % 6).alias("shard"))
    few = graph._bridges(graph._members(df, shard_map), "l2", near=2)
    monkeypatch.setattr(shards, "MAX_SMALL_CENTERS", 3)
    many = graph._bridges(graph._members(df, shard_map), "l2", near=2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() >= 6
