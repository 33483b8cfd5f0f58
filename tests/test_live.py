import random

import pytest
from pyspark.sql import functions as F

from vecloom.functions import validate
from vecloom.operators import live
from vecloom.streaming import oplog

SCHEMA = "op_id long, ts timestamp, seq long, op string, tag long, vec array<float>, labels array<string>"


def replay(ops):
    """What a plain loop over the ops does."""
    alive, status = set(), {}
    for seq, op, tag in ops:
        if op == "insert":
            status[seq] = "reserved" if tag == 0 else "exists" if tag in alive else "ok"
            if tag:
                alive.add(tag)
        else:
            status[seq] = "ok" if tag in alive else "missing"
            alive.discard(tag)
    return alive, status


@pytest.fixture(scope="module")
def script():
    rng = random.Random(5)
    # a third of all ops hit one tag
    return [(n, rng.choice(["insert", "insert", "delete"]), 3 if rng.random() < 0.34 else rng.randrange(12)) for n in range(300)]


@pytest.mark.parametrize("piece", [1_000, 7, 1])
def test_statuses_do_not_depend_on_pieces(spark, script, piece):
    ops = spark.createDataFrame(script, "seq long, op string, tag long")
    start = spark.createDataFrame([(5,), (3,)], "tag long")
    before = [(-2, "insert", 5), (-1, "insert", 3)]
    _, want = replay(before + script)
    got = {r.seq: r.status for r in live.resolve_ops(start, ops, chunk=F.floor(F.col("seq") / piece)).collect()}
    assert got == {k: v for k, v in want.items() if k >= 0}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_cut_does_not_matter(spark, script, tmp_path, parts):
    rows = [(n, None, n, op, tag, [float(n)], ["x"]) for n, op, tag in script]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    files = str(tmp_path / "ops")
    for p in range(parts):
        df.where(F.floor(F.col("seq") * parts / 300) == p).coalesce(1).write.mode("append").parquet(files)
    log = oplog.replay(spark, files, df.schema, str(tmp_path / "log"), str(tmp_path / "ck"), snapshot_every=2)
    alive, want = replay(script)
    assert {r.tag for r in log.live().collect()} == alive
    assert {r.seq: r.status for r in log.statuses().collect()} == want
    # the same micro-batch once more changes nothing
    last = parts - 1
    log.append(last, df.where(F.floor(F.col("seq") * parts / 300) == last).select("tag", "op", "seq", "vec", "labels"))
    assert {r.tag for r in log.live_tags().collect()} == alive


def test_insert_search_delete_script(spark):
    empty = spark.createDataFrame([], "tag long, vec array<float>")
    batch = spark.createDataFrame([(0, 10099, [1.0]), (1, 10050, [2.0]), (2, 10053, [3.0]), (3, 10050, [4.0]), (4, 0, [5.0])], "seq long, tag long, vec array<float>")
    state, status, _ = live.apply_inserts(empty, batch)
    assert {r.seq: r.status for r in status.collect()} == {0: "ok", 1: "ok", 2: "ok", 3: "exists", 4: "reserved"}
    state, gone, status = live.apply_deletes(state, spark.createDataFrame([(0, 10050), (1, 7)], "seq long, tag long"))
    assert sorted(r.tag for r in state.collect()) == [10053, 10099]
    assert {r.seq: r.status for r in status.collect()} == {0: "ok", 1: "missing"} and gone.count() == 1


def test_capacity(spark):
    two = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "tag long, vec array<float>")
    one = spark.createDataFrame([(0, 3, [3.0])], "seq long, tag long, vec array<float>")
    _, status, consolidate = live.apply_inserts(two, one, max_points=2)
    assert status.first().status == "full" and consolidate
    left, _, _ = live.apply_deletes(two, spark.createDataFrame([(0, 1)], "seq long, tag long"))
    state, status, consolidate = live.apply_inserts(left, one, max_points=2, deleted=1)
    assert status.first().status == "ok" and consolidate and state.count() == 2


def test_arguments():
    with pytest.raises(ValueError):
        validate.check_metric("int8", "mips")
    with pytest.raises(ValueError):
        validate.check_metric("float64", "l2")
    for bad in (0, -1, 1.5, True, "3"):
        with pytest.raises(ValueError):
            validate.check_positive(k=bad)
    with pytest.raises(ValueError):
        validate.list_size(10, 5)
    with pytest.warns(UserWarning):
        assert validate.list_size(10, 5, bump=True) == 10


def test_bad_vectors_are_refused(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0]), (-3, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    with pytest.raises(ValueError, match="repeated"):
        validate.validate_vectors(df, "l2")


def op_rows(spark, script):
    rows = [(n, None, n, op, tag, [float(n)], ["x"]) for n, op, tag in script]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))


def test_batch_reads_its_buckets_only(spark, tmp_path):
    """The plan of a batch that names one tag opens one bucket; the others keep their files."""
    log = oplog.OpLog(spark, str(tmp_path / "log"), buckets=8).create()
    first = op_rows(spark, [(n, "insert", n + 1) for n in range(80)])
    log.append(0, first.select("tag", "op", "seq", "vec", "labels"))
    one = op_rows(spark, [(100, "delete", 5)]).select("tag", "op", "seq", "vec", "labels")
    before = log.version()
    opened = {f.split("bucket=")[1].split("/")[0] for f in log.tables.matching(before, "live", one).inputFiles()}
    assert opened == {str(b) for b in log.tables.table("live").touched(one)} and len(opened) == 1
    log.append(1, one)
    after = log.version()
    assert sum(a != b for a, b in zip(before.gens["live"], after.gens["live"])) == 1
    assert sorted(r.tag for r in log.live().collect()) == [t for t in range(1, 81) if t != 5]
    assert log.live(1).count() == 80
    log.compact()
    assert log.tables.numbers() == [1] and log.live().count() == 79


@pytest.mark.parametrize("cuts", [[300], [100, 300], [40, 41, 300]])
def test_last_writer_state(spark, script, tmp_path, cuts):
    """Any cut, shuffled inside, and a new start from the checkpoint after every piece."""
    from vecloom.streaming.last_writer import last_writer_state, read_last_state
    df, files, out, ck = op_rows(spark, script), str(tmp_path / "ops"), str(tmp_path / "out"), str(tmp_path / "ck")
    at = 0
    for cut in cuts:
        df.where((F.col("seq") >= at) & (F.col("seq") < cut)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema(df.schema).parquet(files)
        last_writer_state(stream, out, ck).awaitTermination()
        at = cut
    want = {tag: (seq, op) for seq, op, tag in script}
    assert {r.tag: (r.op_id, r.op) for r in read_last_state(spark, out).collect()} == want


def test_last_writer_forgets_deleted(spark, tmp_path):
    from vecloom.streaming.last_writer import last_writer_state, read_last_state
    files, out, ck = str(tmp_path / "ops"), str(tmp_path / "out"), str(tmp_path / "ck")
    pieces = [[(0, "insert", 1), (1, "insert", 2), (2, "delete", 1)], [(5_000, "insert", 3)], [(9_000, "insert", 4)], [(9_500, "insert", 1)]]
    seen = []
    for piece in pieces:
        df = op_rows(spark, piece)
        df.coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema(df.schema).parquet(files)
        last_writer_state(stream, out, ck, watermark="10 seconds", keep_deleted_ms=60_000).awaitTermination()
        seen.append({r.tag: r.op for r in read_last_state(spark, out).collect()})
    assert seen[0] == {1: "delete", 2: "insert"}
    assert seen[2] == {2: "insert", 3: "insert", 4: "insert"}  # the delete of 1 is out of the state
    assert seen[3] == {1: "insert", 2: "insert", 3: "insert", 4: "insert"}
    with pytest.raises(ValueError):
        last_writer_state(stream, out, ck, keep_deleted_ms=5)


def test_last_op_of_a_bucket():
    """One read, one write and one merge serve all tags of a bucket; the timer is that of the first delete."""
    import pandas as pd

    from vecloom.streaming.last_writer import LastOp

    class Handle:
        def __init__(self):
            self.value, self.timers, self.calls = None, [], []

        def getValueState(self, name, schema):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, timer):
            self.timers = [t for t in self.timers if t != timer]

        def registerTimer(self, timer):
            self.timers.append(timer)

    class At:
        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: 6_000

    def frame(rows):
        return pd.DataFrame([(t, u, pd.Timestamp(ts, unit="s"), o, op) for t, u, ts, o, op in rows], columns=["tag", "untagged", "ts", "op_id", "op"])

    handle, state = Handle(), LastOp(1_000)
    state.init(handle)
    many = [(t, False, 1, t, "insert") for t in range(500)]
    first = list(state.handleInputRows((1,), iter([frame(many), frame([(0, True, 2, 900, "delete"), (7, False, 5, 901, "delete"), (8, False, 0, 902, "delete")])]), None))
    assert len(first) == 1 and handle.calls == ["update"] and handle.timers == [3_000]
    got = {(None if r.tag is None or pd.isna(r.tag) else int(r.tag)): (r.op_id, r.op) for r in first[0].itertuples()}
    assert len(got) == 501 and got[None] == (900, "delete") and got[7] == (901, "delete") and got[8] == (8, "insert")
    assert list(state.handleInputRows((1,), iter([frame([(7, False, 4, 999, "insert")])]), None)) == []  # older: nothing changes
    gone = list(state.handleExpiredTimer((1,), At(), At()))[0]
    assert sorted(gone["op_id"]) == [900, 901] and gone["expired"].all() and handle.timers == []
    again = list(state.handleInputRows((1,), iter([frame([(7, False, 4, 999, "insert")])]), None))[0]
    assert again["op_id"].tolist() == [999]
