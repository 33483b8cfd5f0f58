import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import evaluate, graph, labels, live, search, shards
from vecloom.operators.knn import exact_knn
from vecloom.operators.shards import shard_points
from vecloom.plans.scratch import stored


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 8)).round(4)
    rows = [(n, v, ["even" if n % 2 == 0 else "odd"] + (["by_three"] if n % 3 == 0 else [])) for n, v in enumerate(x.tolist())]
    df = stored(spark.createDataFrame(rows, "id long, vec array<double>, labels array<string>").repartition(4))
    edges = graph.build_graph(df, R=16, L=40)
    entry = stored(shards.medoid(df).select("id"))
    queries = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return df, edges, entry, queries


def faults(df, edges, R):
    return sum(graph.check_graph(df, edges, R).first())


def test_built_graph_is_sound_and_searchable(world):
    df, edges, entry, queries = world
    assert faults(df, edges, 16) == 0
    walk = search.graph_search(edges, df, queries, entry, 10, 40, W=8)
    truth = exact_knn(df, queries, 10, skip_same=True)
    assert evaluate.recall(walk.results(10, skip_same=True), truth, 10).first().recall >= 95
    near = walk.results(1).collect()
    assert len(near) == 240 and all(r.id == r.qid and r.dist == 0 for r in near)


def test_narrow_and_wide_steps_agree_on_distances(world):
    df, edges, entry, queries = world
    a = {(r.qid, r["rank"]): r.dist for r in search.graph_search(edges, df, queries, entry, 5, 24, W=4).results(5).collect()}
    b = {(r.qid, r["rank"]): r.dist for r in search.graph_search(edges, df, queries, entry, 5, 24, W=24).results(5).collect()}
    same = sum(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert same >= 0.95 * len(a)


def test_large_index_and_many_queries_take_the_same_walk(world, monkeypatch):
    import vecloom.plans.blocks as blocks
    df, edges, entry, queries = world
    want = search.graph_search(edges, df, queries, entry, 5, 30, W=10).results(5)
    monkeypatch.setattr(search, "FIRST_HOP_ROWS", 3)
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 3)
    got = search.graph_search(edges, df, queries, entry, 5, 30, W=10).results(5)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 1200


def test_round_cap_still_answers(world):
    df, edges, entry, queries = world
    walk = search.graph_search(edges, df, queries, entry, 3, 20, W=4, max_rounds=2)
    assert walk.results(3).select("qid").distinct().count() == 240
    assert walk.stats.agg(F.max("n_rounds")).first()[0] <= 3


def test_filtered_search_returns_only_matching(world):
    df, _, entry, queries = world
    edges = graph.build_graph(df, R=24, L=30, labels=True)
    asked = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.lit("by_three").alias("label"))
    starts = labels.query_label_starts(labels.label_entry_points(df))
    found = search.graph_search(edges, df, asked, entry, 5, 40, starts=starts).results(5)
    assert found.where("id % 3 <> 0").isEmpty()
    assert found.select("qid").distinct().count() == 240
    bad = asked.withColumn("label", F.lit("nobody"))
    with pytest.raises(ValueError):
        search.graph_search(edges, df, bad, entry, 5, 40, starts=starts)


def test_list_must_hold_k(world):
    df, edges, entry, queries = world
    with pytest.raises(ValueError):
        search.graph_search(edges, df, queries, entry, 10, 5)


def test_sharded_and_stitched_builds(world, spark):
    df, _, _, _ = world
    centers = shards.kmeans(df, 4, reps=5)
    merged = graph.build_sharded(df, R=18, L=30, shard_map=shard_points(df, centers, 2))
    assert faults(df, merged, 18) == 0
    stitched = graph.build_stitched(df, R=8, L=20, R_stitched=16)
    assert faults(df, stitched, 16) == 0


def test_consolidation_never_points_at_deleted(world):
    df, edges, _, _ = world
    dead = df.where("id % 7 = 0").select("id")
    after, report = live.consolidate(edges, dead, df, 16)
    assert after.where("src % 7 = 0 OR dst % 7 = 0").isEmpty()
    row = report.first()
    assert row.deleted_points == 35 and row.repaired_points > 0
    assert after.groupBy("src").count().agg(F.max("count")).first()[0] <= 16


def test_prune_pool_keeps_the_nearest(world, spark):
    df, _, _, _ = world
    from vecloom.operators.prune import robust_prune
    cands = exact_knn(df, df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 30, skip_same=True)
    cands = stored(cands.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist"))
    few = robust_prune(cands, df, 5, maxc=10)
    rank = cands.join(few.select("src", "dst"), ["src", "dst"], "left_semi")
    tenth = cands.groupBy("src").agg(F.element_at(F.array_sort(F.collect_list("dist")), 10).alias("edge"))
    assert rank.join(tenth, "src").where("dist > edge").isEmpty()


def test_range_search_is_a_subset(world):
    df, edges, entry, queries = world
    from vecloom.operators.ranges import range_join
    found = search.graph_range_search(edges, df, queries, entry, 6.0, 8, 64)
    exact = range_join(df, queries, 6.0)
    assert found.select("qid", "id").exceptAll(exact.select("qid", "id")).isEmpty()
    assert found.count() >= 0.9 * exact.count()


@pytest.mark.parametrize("options", [{}, {"metric": "cosine"}, {"labels": True}, {"max_rounds": 2}, {"codes": True}])
def test_joined_walk_is_the_walk_in_tasks(spark, points, options):
    """The same lists, traces and counts, whether the index is sent to the queries or joined round by round."""
    from vecloom.operators.pq import pq_encode, pq_train
    from vecloom.operators.search import graph_search
    df, _, _ = points
    options = dict(options)
    edges = graph.build_graph(df, R=10, L=20, labels=options.pop("labels", False))
    asked = df.where("id % 7 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    nodes, more = df, {}
    if options.pop("codes", False):
        book = pq_train(df.select("id", "vec"), 4, seed=1)
        nodes, more = pq_encode(df.select("id", "vec"), book), {"quantizer": book}
    entry = df.where("id = 150").select("id")
    runs = [graph_search(edges, nodes, asked, entry, 5, 15, W=4, held_rows=n, **options, **more) for n in (0, 65_536)]
    for part in ("lists", "trace", "stats"):
        a, b = (sorted(tuple(r) for r in getattr(w, part).collect()) for w in runs)
        assert a == b and a


def test_joined_filtered_walk(spark, points):
    from vecloom.operators.labels import label_entry_points, query_label_starts
    from vecloom.operators.search import graph_search
    df, _, labels = points
    edges = graph.build_graph(df, R=10, L=20, labels=True)
    asked = spark.createDataFrame([(n, [float(n % 3)] * 12, ["hot", "l1", "l2"][n % 3]) for n in range(30)], "qid long, qvec array<double>, label string")
    starts = query_label_starts(label_entry_points(df))
    runs = [graph_search(edges, df, asked, df.where("id = 1").select("id"), 5, 15, starts=starts, universal="all", held_rows=n) for n in (0, 65_536)]
    a, b = (sorted(tuple(r) for r in w.results(5).collect()) for w in runs)
    assert a == b and a
