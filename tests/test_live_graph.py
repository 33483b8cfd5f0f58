import random

import pytest
from pyspark.sql import functions as F

from vecloom.operators import graph, incremental
from vecloom.operators.knn import exact_knn
from vecloom.operators.evaluate import recall
from vecloom.plans.lookup import hot_lookup
from vecloom.sources.buckets import EMPTY, VersionedTables
from vecloom.streaming.live_graph import LiveGraph, run_live_graph

OPS = "op_id long, seq long, op string, tag long, vec array<float>, labels array<string>"


@pytest.fixture
def tables(spark, tmp_path):
    layout = {"t": ("id", "id long, x string"), "u": ("id", "id long, a array<struct<p:double,q:bigint>>")}
    out = VersionedTables(spark, str(tmp_path / "tables"), layout, buckets=8)
    out.create({"n": 0})
    return out


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id long, x string")


def test_versions_share_buckets(spark, tables):
    v0 = tables.change(tables.version(), "t", rows(spark, [(i, f"a{i}") for i in range(100)]))
    v0.number = 0
    tables.publish(v0)
    v1 = tables.change(tables.version(), "t", rows(spark, [(7, "new"), (200, "more")]), rows(spark, [(8, "")]))
    v1.number = 1
    tables.publish(v1)
    changed = [b for b in range(8) if v0.gens["t"][b] != v1.gens["t"][b]]
    touched = tables.table("t").touched(rows(spark, [(7, ""), (8, ""), (200, "")]))
    assert changed == touched and len(changed) < 8
    old = {r.id: r.x for r in tables.read(tables.version(0), "t").collect()}
    new = {r.id: r.x for r in tables.read(tables.version(), "t").collect()}
    assert old == {i: f"a{i}" for i in range(100)}
    assert new == {**{i: f"a{i}" for i in range(100) if i != 8}, 7: "new", 200: "more"}
    assert [r.x for r in tables.matching(tables.version(), "t", rows(spark, [(7, "")])).collect()] == ["new"]
    # only the bucket asked for is in the plan
    files = tables.matching(tables.version(), "t", rows(spark, [(7, "")])).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files} == {str(b) for b in tables.table("t").touched(rows(spark, [(7, "")]))}


def test_publishing_again_and_vacuum(spark, tables):
    for n in range(3):
        for _ in range(2):  # a repeated change writes the same generation
            v = tables.change(tables.version(None if n == 0 else n - 1), "t", rows(spark, [(i, f"{n}") for i in range(n, 30)]))
        v.number = n
        tables.publish(v)
    gone = tables.vacuum(1)
    assert tables.numbers() == [2] and len(gone) >= 3
    assert sorted((r.id, r.x) for r in tables.read(tables.version(), "t").collect()) == [(0, "0"), (1, "1")] + [(i, "2") for i in range(2, 30)]
    with pytest.raises(ValueError):
        tables.version(0)
    v = tables.change(tables.version(), "t", rows(spark, []), rows(spark, [(i, "") for i in range(30)]))
    assert set(v.gens["t"]) == {EMPTY} and tables.read(v, "t").count() == 0


def test_hot_lookup(spark):
    left = spark.createDataFrame([(i % 3 if i % 2 else 1000 + i, i) for i in range(300)], "k long, i long")
    uses = left.groupBy("k").count().withColumnRenamed("count", "uses").withColumn("v", F.col("k") * 2)
    right = uses.where("k <> 1002")
    got = hot_lookup(left, right, "k", "uses")
    assert sorted((r.k, r.i, r.v) for r in got.collect()) == sorted(
        (r.k, r.i, r.k * 2) for r in left.collect() if r.k != 1002)


def check_view(view, want, R, asked, k=5, least=90):
    """The version holds the wanted tags, a sound graph that reaches all its points, and good answers."""
    live = view.live
    assert sorted(r.tag for r in live.select("tag").collect()) == sorted(want)
    faults = graph.check_graph(view.held, view.edges, R).first()
    assert tuple(faults) == (0, 0, 0, 0)
    if want:
        found = view.search(asked, k, 30)
        assert {r.tag for r in found.collect()} <= set(want)
        assert recall(found, exact_knn(live.select("id", "vec"), asked, k), k).first().recall >= least


@pytest.fixture(scope="module")
def script():
    """Ops on 90 tags, a third of them on one tag."""
    rng = random.Random(8)
    out = []
    for n in range(260):
        tag = 3 if rng.random() < 0.33 else rng.randrange(90)
        out.append((n, n, rng.choice(["insert", "insert", "delete"]), tag, [rng.gauss(0, 1) for _ in range(6)], [f"l{tag % 3}"]))
    return out


def replay(ops):
    alive = {}
    for _, seq, op, tag, vec, _ in ops:
        if op == "insert" and tag and tag not in alive:
            alive[tag] = vec
        elif op == "delete":
            alive.pop(tag, None)
    return alive


def asked_of(spark, script):
    return spark.createDataFrame([(n, s[4], s[5][0]) for n, s in enumerate(script[:20])], "qid long, qvec array<float>, label string")


@pytest.mark.parametrize("parts", [1, 3])
def test_stream(spark, script, tmp_path, parts):
    """Every cut gives the live set of a plain loop; older versions stay; a repeated batch changes nothing."""
    files, n = str(tmp_path / "ops"), len(script)
    df = spark.createDataFrame(script, OPS)
    for p in range(parts):
        df.where(F.floor(F.col("seq") * parts / n) == p).coalesce(1).write.mode("append").parquet(files)
    g = LiveGraph(spark, str(tmp_path / "graph"), R=8, L=20, buckets=4)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(files)
    run_live_graph(stream, g, str(tmp_path / "ck")).awaitTermination()
    asked = asked_of(spark, script).drop("label")
    for batch in range(parts):
        done = [s for s in script if s[1] * parts // n <= batch]
        want = replay(done)
        view = g.view(batch)
        assert {r.tag: [round(x, 4) for x in r.vec] for r in view.live.collect()} == {
            t: [round(x, 4) for x in v] for t, v in want.items()}
        if batch == parts - 1:
            check_view(view, want, 8, asked)
    before = g.tables.version()
    assert g.apply(parts - 1, df).version.gens == before.gens
    assert g.statuses().where("status = 'reserved'").count() == sum(s[2] == "insert" and s[3] == 0 for s in script)


def test_labels_and_slots(spark, script, tmp_path):
    """Two slots for three labels: points of the third are refused; starts are handed over, then given up."""
    g = LiveGraph(spark, str(tmp_path / "graph"), R=8, L=20, filtered=True, slots=2, buckets=4, consolidate_share=0.01).create()
    fresh = [(t, t, "insert", t, s[4], [f"l{t % 3}"]) for t, s in enumerate(script[:60], start=1)] + [(99, 99, "insert", 99, [0.0] * 6, None)]
    view = g.apply(0, spark.createDataFrame(fresh, OPS))
    assert {(r.status, r.n) for r in g.statuses().groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        ("ok", 40), ("no_slot", 20), ("no_labels", 1)}
    starts = {r.label: r.id for r in view.table("starts").collect()}
    assert set(starts) == {"l0", "l1"}
    first = {r.id: r.tag for r in view.held.collect()}[starts["l1"]]
    view = g.apply(1, spark.createDataFrame([(200, 200, "delete", first, None, None)], OPS))
    assert view.table("gone").count() == 0 and view.held.count() == 39
    new = {r.label: r.id for r in view.table("starts").collect()}
    assert new["l0"] == starts["l0"] and new["l1"] != starts["l1"]
    assert incremental.unreached(view.table("lists"), view.held, view.entry, view.table("starts")).count() == 0
    found = view.search(asked_of(spark, script), 5, 20)
    carried = {r.id: r.labels[0] for r in view.live.collect()}
    label = {n: s[5][0] for n, s in enumerate(script[:20])}
    rows_ = found.collect()
    assert rows_ and all(carried[r.id] == label[r.qid] for r in rows_)
    assert {r.qid for r in rows_} == {q for q, x in label.items() if x != "l2"}  # nobody carries l2
    rest = [(300 + t, 300 + t, "delete", t, None, None) for t in range(1, 61) if t % 3 == 1]
    view = g.apply(2, spark.createDataFrame(rest, OPS))
    assert {r.label for r in view.table("starts").collect()} == {"l0"}
    view = g.apply(3, spark.createDataFrame([(400, 400, "insert", 500, [0.0] * 6, ["l2"])], OPS))
    assert {r.label for r in view.table("starts").collect()} == {"l0", "l2"}  # the slot given up is used again


def test_all_leave(spark, tmp_path):
    g = LiveGraph(spark, str(tmp_path / "graph"), R=4, L=8, buckets=2).create()
    g.apply(0, spark.createDataFrame([(n, n, "insert", n + 1, [float(n), 1.0], None) for n in range(5)], OPS))
    view = g.apply(1, spark.createDataFrame([(9 + n, 9 + n, "delete", n + 1, None, None) for n in range(5)], OPS))
    assert view.held.count() == 0 and view.version.notes["entry"] is None and view.edges.count() == 0
    asked = spark.createDataFrame([(0, [0.0, 1.0])], "qid long, qvec array<float>")
    assert view.search(asked, 1, 4).collect() == []
    view = g.apply(2, spark.createDataFrame([(20, 20, "insert", 7, [2.0, 2.0], None)], OPS))
    assert [r.tag for r in view.search(asked, 1, 4).collect()] == [7]
    assert [r.tag for r in g.view(0).search(asked, 1, 4).collect()] == [1]  # an older version still answers


def test_removal_bridges(spark):
    """A point that loses a hub gets the hub's live neighbours; what it had stays."""
    vecs = [(n, [float(n), 0.0]) for n in range(6)]
    points = spark.createDataFrame(vecs, "id long, vec array<double>")
    edges = [(0, 5), (1, 5), (2, 5), (5, 3), (5, 4), (3, 4), (4, 0)]
    df = spark.createDataFrame([(a, b, float((a - b) ** 2)) for a, b in edges], "src long, dst long, dist double")
    delta = incremental.removal_delta(incremental.as_lists(df), points, spark.createDataFrame([(5,)], "id long"), R=4, alpha=1.2)
    assert {r.src: [(e.dst, e.dist) for e in r.nbrs] for r in delta.collect()} == {
        0: [(3, 9.0), (4, 16.0)], 1: [(3, 4.0), (4, 9.0)], 2: [(3, 1.0), (4, 4.0)]}


def test_growing_by_doubling(spark, points):
    df, x, _ = points
    edges, entry = incremental.grow_graph(df.select("id", "vec"), R=12, L=30, seed_rows=40)
    from vecloom.operators.search import graph_search
    assert tuple(graph.check_graph(df, edges, 12).first()) == (0, 0, 0, 0)
    asked = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    found = graph_search(edges, df, asked, entry, 1, 30).results(1)
    assert found.where("dist = 0").count() >= 290
