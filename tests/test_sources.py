import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.sources import snapshot, synthetic, textfiles, truthfiles, vecfiles


@pytest.fixture()
def frame(spark):
    x = np.arange(60.0).reshape(20, 3)
    return spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "id long, vec array<float>"), x


@pytest.mark.parametrize("kind,dtype", [("bin", "float"), ("bin", "int8"), ("bin", "uint8"), ("fvecs", None), ("bvecs", None), ("ivecs", None)])
def test_round_trip(spark, frame, tmp_path, kind, dtype):
    df, x = frame
    path = str(tmp_path / "v")
    vecfiles.write_vectors(df, path, kind, dtype, rows_per_file=7)
    back = vecfiles.read_vectors(spark, path, kind, dtype).orderBy("id").collect()
    assert [r.id for r in back] == list(range(20))
    assert np.array_equal([r.vec for r in back], x)
    part = vecfiles.read_vectors(spark, path, kind, dtype, offset=5, limit=9).orderBy("id").collect()
    assert [r.id for r in part] == list(range(5, 14))


def test_files_made_by_hand_are_read_in_byte_ranges(spark, tmp_path, monkeypatch):
    x = np.arange(400, dtype="<f4").reshape(100, 4)
    path = tmp_path / "hand.bin"
    path.write_bytes(np.array([100, 4], "<i4").tobytes() + x.tobytes())
    monkeypatch.setattr(vecfiles, "RANGE_BYTES", 160)
    df = vecfiles.read_vectors(spark, str(path))
    assert df.rdd.getNumPartitions() == 10
    assert np.array_equal([r.vec for r in df.orderBy("id").collect()], x)
    path.write_bytes(np.array([101, 4], "<i4").tobytes() + x.tobytes())
    with pytest.raises(Exception, match="do not hold"):
        vecfiles.read_vectors(spark, str(path)).count()


def test_overwrite_leaves_one_set(spark, frame, tmp_path):
    df, _ = frame
    path = str(tmp_path / "v")
    vecfiles.write_vectors(df, path, rows_per_file=3)
    vecfiles.write_vectors(df.where("id < 4"), path)
    assert vecfiles.read_vectors(spark, path).count() == 4


def test_tags_must_match(spark, frame, tmp_path):
    df, _ = frame
    path = str(tmp_path / "tags")
    vecfiles.write_tags(df.select("id", (F.col("id") + 1).alias("tag")), path)
    assert vecfiles.read_tags(spark, path, df).where("tag <> id + 1").isEmpty()
    with pytest.raises(ValueError, match="tags for"):
        vecfiles.read_tags(spark, path, df.where("id < 3"))
    vecfiles.write_vectors(df, path, "bin", "uint32")
    with pytest.raises(ValueError, match="width 1"):
        vecfiles.read_tags(spark, path, df)


def test_label_lines(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_bytes(b"b,a\tignored\r\n\nc\n")
    rows = textfiles.read_labels(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.labels) for r in rows] == [(0, ["a", "b"]), (1, []), (2, ["c"])]


def test_tsv_width(spark, frame, tmp_path):
    df, x = frame
    path = str(tmp_path / "tsv")
    textfiles.write_tsv(df, path)
    back = textfiles.read_tsv(spark, path, 3).orderBy("id").collect()
    assert np.array_equal([r.vec for r in back], x)
    with pytest.raises(Exception, match="another width"):
        textfiles.read_tsv(spark, path, 4).collect()


def test_truth_forms(spark, tmp_path):
    truth = spark.createDataFrame(
        [(q, r, q * 10 + r, float(r)) for q in range(9) for r in range(1, 5)], "qid long, rank int, id long, dist double")
    path = str(tmp_path / "t")
    truthfiles.write_truth(truth, path, queries_per_file=2)
    assert truthfiles.read_truth(spark, path).exceptAll(truth).isEmpty()
    truthfiles.write_truth(truth, path, with_dist=False)
    ids = truthfiles.read_truth(spark, path)
    assert ids.columns == ["qid", "rank", "id"] and ids.count() == 36
    one = tmp_path / "one.bin"
    one.write_bytes(np.array([2, 3], "<i4").tobytes() + np.arange(6, dtype="<u4").tobytes())
    assert truthfiles.read_truth(spark, str(one)).where("id <> qid * 3 + rank - 1").isEmpty()


def test_range_truth_with_empty_queries(spark, tmp_path):
    queries = spark.range(7).select(F.col("id").alias("qid"))
    truth = spark.createDataFrame([(1, 5, .2), (1, 4, .1), (4, 9, .3), (6, 1, .0), (6, 2, .0)], "qid long, id long, dist double")
    path = str(tmp_path / "r")
    truthfiles.write_range_truth(truth, queries, path, queries_per_file=3)
    got = sorted((r.qid, r.pos, r.id) for r in truthfiles.read_range_truth(spark, path).collect())
    assert got == [(1, 0, 4), (1, 1, 5), (4, 0, 9), (6, 0, 1), (6, 1, 2)]


def test_snapshot_checks_counts(spark, frame, tmp_path):
    df, _ = frame
    path = str(tmp_path / "s")
    tags = df.select("id", F.col("id").alias("tag"))
    snapshot.save_snapshot(spark, path, 1, {"vectors": df, "tags": tags})
    snapshot.save_snapshot(spark, path, 2, {"vectors": df.where("id < 5"), "tags": tags.where("id < 5")})
    assert snapshot.load_snapshot(spark, path)["vectors"].count() == 5
    assert snapshot.load_snapshot(spark, path, 1)["vectors"].count() == 20
    snapshot.save_snapshot(spark, path, 3, {"vectors": df, "tags": tags.where("id < 5")})
    with pytest.raises(ValueError, match="different counts"):
        snapshot.load_snapshot(spark, path)


def test_generated_shapes(spark):
    rows = synthetic.gen_vectors(spark, 200, 6, "int8", norm=50.0, seed=1)
    assert rows.schema["vec"].dataType.elementType.typeName() == "byte" and rows.count() == 200
    with pytest.raises(ValueError):
        synthetic.gen_vectors(spark, 2, 2, "int8")
    zipf = synthetic.gen_labels(spark, 400, 20, "zipf", seed=2)
    first = zipf.where(F.array_contains("labels", "1")).count()
    tenth = zipf.where(F.array_contains("labels", "10")).count()
    assert tenth < first <= 280 and tenth <= 28
    assert zipf.where(F.size("labels") == 0).isEmpty()


def test_files_refuse_what_they_cannot_hold(spark, tmp_path):
    path = str(tmp_path / "big")
    tags = spark.createDataFrame([(0, 7), (1, (1 << 32) + 5)], "id long, tag long")
    with pytest.raises(Exception, match="do not fit"):
        vecfiles.write_tags(tags, path)
    vecfiles.write_tags(tags, path, "int64")
    assert {tuple(r) for r in vecfiles.read_tags(spark, path, tags, "int64").collect()} == {(0, 7), (1, (1 << 32) + 5)}
    truth = spark.createDataFrame([(0, 1, 1 << 32, .1)], "qid long, rank int, id long, dist double")
    with pytest.raises(Exception, match="do not fit"):
        truthfiles.write_truth(truth, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="numbers its queries"):
        truthfiles.write_truth(truth.selectExpr("qid + 4 AS qid", "rank", "1L AS id", "dist"), str(tmp_path / "u"))


def test_delta_snapshots(spark, tmp_path):
    """Unchanged buckets are shared; both versions load; rows may repeat a key; other columns are refused."""
    from vecloom.sources import snapshot
    path = str(tmp_path / "snap")
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], "id long, vec array<double>")
    e = spark.createDataFrame([(i, (i + k) % 200, float(k)) for i in range(200) for k in (1, 2)], "src long, dst long, dist double")
    both = lambda v, e: {"vectors": ("id", v), "edges": ("src", e)}
    assert snapshot.save_delta_snapshot(spark, path, 3, both(v, e), buckets=16) == {"vectors": 16, "edges": 16}
    assert snapshot.save_delta_snapshot(spark, path, 4, both(v.repartition(7), e), buckets=16) == {"vectors": 0, "edges": 0}
    changed = v.where("id <> 7").unionByName(spark.createDataFrame([(7, [0.5, 0.5])], v.schema))
    assert snapshot.save_delta_snapshot(spark, path, 5, both(changed, e.limit(0)), buckets=16) == {"vectors": 1, "edges": 0}
    sums = {n: snapshot.load_delta_snapshot(spark, path, n)["vectors"].agg(F.sum(F.col("vec")[0]), F.count(F.lit(1))).first() for n in (3, 4, 5)}
    assert tuple(sums[3]) == tuple(sums[4]) == (19900.0, 200) and tuple(sums[5]) == (19893.5, 200)
    assert snapshot.load_delta_snapshot(spark, path, 3)["edges"].count() == 400
    assert snapshot.load_delta_snapshot(spark, path)["edges"].count() == 0
    with pytest.raises(ValueError):
        snapshot.save_delta_snapshot(spark, path, 6, {"vectors": ("id", v)}, buckets=16)


def test_id_range_opens_its_bytes(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.createDataFrame([(n, [float(n), 0.5]) for n in range(100)], "id long, vec array<float>")
    vecfiles.write_vectors(df, path, "bin", rows_per_file=20)
    assert sorted(r.id for r in vecfiles.read_vector_range(spark, path, 37, 63).where("id <> 40").collect()) == [n for n in range(37, 63) if n != 40]
    assert vecfiles.read_vector_range(spark, path, 90, 10).count() == 0
    reader = vecfiles._FilteringReader(path, vecfiles.Layout("bin", "float"), 0, None)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan
    left = list(reader.pushFilters([GreaterThanOrEqual(("id",), 37), LessThan(("id",), 63), EqualTo(("vec",), 1)]))
    assert left == [EqualTo(("vec",), 1)]
    assert sum(p.value[3] - p.value[2] for p in reader.partitions()) == 26


def test_stream_of_files(spark, tmp_path):
    """Whole files once each, ids going on; a file with an earlier name is refused."""
    path, seen = str(tmp_path / "in"), {}

    def run():
        def save(batch, batch_id):
            seen.update({r.id: (r.vec[0], batch_id) for r in batch.collect()})

        vecfiles.stream_vectors(spark, path, "fvecs").writeStream.foreachBatch(save).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    def put(name, low, high):
        df = spark.createDataFrame([(n, [float(n)]) for n in range(low, high)], "id long, vec array<float>")
        vecfiles.write_vectors(df, str(tmp_path / name), "fvecs", rows_per_file=7)
        vecfiles.arrive(str(tmp_path / name), path, name)

    put("b", 0, 20)
    run()
    put("c", 20, 30)
    run()
    run()
    assert seen == {n: (float(n), 0 if n < 20 else 1) for n in range(30)}
    put("a", 30, 31)
    put("d", 31, 32)
    with pytest.raises(Exception, match="names before"):
        run()
