"""Prefix trie of rebuilt conversations; subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import lookup
from vecloom.plans.scratch import compute_partitions, small_or_same, stored

#: A prefix is named by the sum of its turns' digests times powers of a fixed number, modulo a prime. Sums can be carried
#: over from part to part, so that even one endless conversation is cut among tasks. Two of N prefixes of at most d turns
#: share a name with a probability of about d * N * N / 2**128.
PRIME = (1 << 127) - 1
FACTOR = int.from_bytes(hashlib.sha256(b"prefix").digest()[:15], "big") | 1
ZERO = bytes(16)

SHARE_TURNS = 8       # h is below 9, so a conversation takes at most 8 turns of another
UNIT = 4096           # turns (with repetitions) below a node up to which its subtree stays in one shard
RUN = 250_000         # messages a queue holds in memory
STRETCH = 65_536      # nodes of one conversation added up in one window
PIECE = 65_536        # bytes of ids joined before they are moved


def _number(name: bytes) -> int:
    return int.from_bytes(name, "big")


def _name(number: int) -> bytes:
    return number.to_bytes(16, "big")


def taken_turns(conv_id: str) -> Column:
    """How many turns of conversation ``c - c % 5`` conversation c begins with: the crc32 of its id as text, modulo 9."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % 9).cast("int")


def _sorted_turns(turns: DataFrame) -> DataFrame:
    """``(part, conv_id, at, before, after, n_bytes)``: turns in order, numbered and named inside their part.

    ``before`` and ``after`` name the turns of the same conversation and part up to this one, without and with it.
    """
    said = F.concat(F.octet_length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text"))
    rows = turns.select(
        "conv_id", "turn", F.unhex(F.sha2(said, 256)).alias("_digest"), F.octet_length("_text").cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("_tie"))  # spreads one turn that is repeated endlessly
    order = ["conv_id", F.col("turn").asc_nulls_first(), "_digest", "_tie"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, at, total, power = None, 0, 0, 1
        for batch in batches:
            convs, digests = batch.column("conv_id").to_pylist(), batch.column("_digest").to_pylist()
            ats, names, ends = [], [], []
            for conv, digest in zip(convs, digests):
                if conv != current:
                    current, at, total, power = conv, 0, 0, 1
                ats.append(at)
                names.append(_name(total))
                total = (total + (int.from_bytes(digest[:15], "big") + 1) * power) % PRIME
                ends.append(_name(total))
                power = power * FACTOR % PRIME
                at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(convs), pa.int32()), batch.column("conv_id"), pa.array(ats, pa.int64()),
                 pa.array(names, pa.binary()), pa.array(ends, pa.binary()), batch.column("n_bytes")],
                ["part", "conv_id", "at", "before", "after", "n_bytes"])

    n = compute_partitions(turns.sparkSession)
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        number, "part int, conv_id long, at long, before binary, after binary, n_bytes long")


def named_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, at, before, after, n_bytes)`` of every turn, numbered from 0 and named over its whole conversation.

    Only the first conversation of a part can have begun earlier; what it brings along, one row per part, passes the driver.
    """
    sorted_ = stored(_sorted_turns(turns), "turns")
    ends = sorted_.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max("conv_id").alias("last"),
        F.max_by(F.struct("at", "after"), F.struct("conv_id", "at")).alias("end")).orderBy("part").collect()
    brought, conv, count, total = {}, None, 0, 0
    for r in ends:
        same = r.first == conv
        if same:
            brought[r.part] = (conv, count, total)
        if not same or r.last != conv:
            conv, count, total = r.last, 0, 0
        total = (total + _number(bytes(r.end.after)) * pow(FACTOR, count, PRIME)) % PRIME
        count += r.end.at + 1
    if not brought:
        return sorted_.drop("part")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("part", "conv_id", "at", "before", "after")}
            for i, (part, conv_id) in enumerate(zip(cols["part"], cols["conv_id"])):
                conv, count, total = brought.get(part, (None, 0, 0))
                if conv_id == conv:
                    power = pow(FACTOR, count, PRIME)
                    cols["at"][i] += count
                    for c in ("before", "after"):
                        cols[c][i] = _name((total + _number(cols[c][i]) * power) % PRIME)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(cols["at"], pa.int64()), pa.array(cols["before"], pa.binary()),
                 pa.array(cols["after"], pa.binary()), batch.column("n_bytes")],
                ["conv_id", "at", "before", "after", "n_bytes"])

    going_on = F.broadcast(turns.sparkSession.createDataFrame(
        [(part, conv) for part, (conv, _, _) in brought.items()], "part int, conv_id long"))  # a row per part at most
    keys = ["part", "conv_id"]
    rest = sorted_.join(going_on, keys, "left_semi").mapInArrow(
        carry, "conv_id long, at long, before binary, after binary, n_bytes long")
    return sorted_.join(going_on, keys, "left_anti").drop("part").unionByName(rest)


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n, h, taken, own_from, base_to, shift, length)``: how each conversation is rebuilt.

    ``taken`` are the turns taken from the base conversation, at most 8; its own go on after its first ``h``.
    """
    heads = turns.groupBy("conv_id").agg(
        (F.max("at") + 1).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("at") < SHARE_TURNS, F.struct("at", "before", "after", "n_bytes")))).alias("_head"))
    heads = stored(heads.withColumn("h", taken_turns("conv_id")), "heads")
    base = heads.select(F.col("conv_id").alias("_base"), F.col("_head").alias("_base_head"))
    none = F.slice("_head", 1, 0)
    both = heads.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 5).join(base, "_base", "left").withColumn(
        "taken", F.slice(F.coalesce("_base_head", none), 1, F.col("h")))
    size = F.size("taken")
    return both.select(
        "conv_id", "n", "h", "taken",
        F.coalesce(F.get(F.col("_head.after"), F.col("h") - 1), F.lit(ZERO)).alias("own_from"),
        F.coalesce(F.get(F.col("taken.after"), size - 1), F.lit(ZERO)).alias("base_to"),
        (F.col("h") - size).alias("shift"),
        (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))


def _own_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns a conversation keeps of its own, named over the rebuilt conversation."""
    kept = turns.withColumn("h", taken_turns("conv_id")).where(F.col("at") >= F.col("h")).drop("h")
    about = convs.select("conv_id", "n", "h", "own_from", "base_to", "shift", "length")
    rows = lookup(kept, about, "conv_id", "n")
    moved = F.col("own_from") != F.col("base_to")  # equal names are those of equal beginnings
    rows = rows.select(
        "conv_id", "length", (F.col("at") - F.col("shift") + 1).alias("depth"), F.col("after").alias("node"),
        F.col("before").alias("parent"), "n_bytes", "own_from", "base_to", "shift", moved.alias("_moved"))
    columns = ["conv_id", "length", "depth", "node", "parent", "n_bytes"]
    back = [pow(FACTOR, -s, PRIME) for s in range(SHARE_TURNS + 1)]

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, to, shift = (batch.column(c).to_pylist() for c in ("own_from", "base_to", "shift"))
            out = {
                c: pa.array([
                    _name((_number(t) + (_number(x) - _number(s)) * back[k]) % PRIME)
                    for x, s, t, k in zip(batch.column(c).to_pylist(), start, to, shift)], pa.binary())
                for c in ("node", "parent")}
            yield pa.RecordBatch.from_arrays([out.get(c, batch.column(c)) for c in columns], columns)

    schema = "conv_id long, length long, depth long, node binary, parent binary, n_bytes long"
    return rows.where(~F.col("_moved")).select(*columns).unionByName(rows.where("_moved").mapInArrow(rename, schema))


def rebuilt_paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, length, depth, node, parent, n_bytes)``: every prefix of every rebuilt conversation, the empty one too."""
    roots = convs.select(
        "conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(ZERO).alias("node"),
        F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"))
    heads = convs.select("conv_id", "length", F.explode("taken").alias("t")).select(
        "conv_id", "length", (F.col("t.at") + 1).alias("depth"), F.col("t.after").alias("node"),
        F.col("t.before").alias("parent"), "t.n_bytes")
    return roots.unionByName(heads).unionByName(_own_turns(turns, convs))


class SpillingQueue:
    """Messages ``(key, key, value, value)`` taken out in key order; what memory doesn't hold waits in sorted files."""

    RECORD = "<qqqq"

    def __init__(self, limit: int = RUN):
        self.limit, self.held, self.runs, self.n_runs = limit, [], [], 0

    def push(self, message: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.held, message)
        if len(self.held) > self.limit:
            self.held.sort()
            run = tempfile.TemporaryFile()
            for a in range(0, len(self.held), 4096):
                run.write(b"".join(struct.pack(self.RECORD, *m) for m in self.held[a:a + 4096]))
            run.seek(0)
            self.held = []
            self.n_runs += 1
            self._next(self._read(run), self.n_runs)

    def _read(self, run) -> Iterator[tuple]:
        with run:
            while block := run.read(struct.calcsize(self.RECORD) * 4096):
                yield from struct.iter_unpack(self.RECORD, block)

    def _next(self, run: Iterator[tuple], n: int) -> None:
        message = next(run, None)
        if message is not None:
            heapq.heappush(self.runs, (message, n, run))

    def take(self, key: tuple[int, int]) -> tuple[int, int]:
        """Sums of the values of all messages with this key, the least one in the queue."""
        first = second = 0
        while self.held and self.held[0][:2] == key:
            _, _, x, y = heapq.heappop(self.held)
            first, second = first + x, second + y
        while self.runs and self.runs[0][0][:2] == key:
            (_, _, x, y), n, run = heapq.heappop(self.runs)
            first, second = first + x, second + y
            self._next(run, n)
        return first, second


def shard_totals(nodes: DataFrame, run: int = RUN) -> DataFrame:
    """``nodes`` with ``n_leaves`` and ``saved_tokens`` of their subtrees, whole subtrees ``unit`` at a time.

    Shards are the partitions. A shard's nodes come sorted deepest level first, so all messages of a node's children are
    in the queue before the node, which adds them to its own and sends the sum on; the root of a unit sends nothing.
    """
    totals = ["n_leaves", "saved_tokens"]

    def pass_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(run)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "depth", "parent_conv_id", "is_root", "leaf", "saved")]
            leaves, saved = [], []
            for conv_id, depth, parent, is_root, leaf, own in zip(*cols):
                x, y = queue.take((-depth, conv_id))
                x, y = x + leaf, y + own
                leaves.append(x)
                saved.append(y)
                if not is_root:
                    queue.push((1 - depth, parent, x, y))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], [*batch.schema.names, *totals])

    schema = nodes.schema
    for c in totals:
        schema = schema.add(c, "long")
    n = compute_partitions(nodes.sparkSession)
    return nodes.repartition(n, "unit").sortWithinPartitions(F.desc("depth"), "conv_id").mapInArrow(pass_up, schema)


def root_totals(heavy: DataFrame, messages: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(conv_id, depth, n_leaves, saved_tokens)`` of the ``heavy`` nodes above the shards.

    Heavy nodes with one ``conv_id`` are a path downwards. ``messages(conv_id, depth, leaves, saved)`` of the shards'
    roots and the nodes' own values meet at their nodes; the sum of a path goes to the node above its top, and so on
    until all have arrived at the root. The totals of a path are then sums from below, long paths in stretches.
    """
    paths = stored(heavy.groupBy("conv_id").agg(
        F.min("depth").alias("_top"), F.min_by("parent_conv_id", "depth").alias("_above")), "paths")
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    own = heavy.select("conv_id", "depth", F.col("leaf").cast("long").alias("leaves"), "saved")
    arrived = going = stored(own.unionByName(messages).groupBy("conv_id", "depth").agg(*sums), "arrived")
    while True:
        going = stored(
            going.groupBy("conv_id").agg(*sums).join(paths.where("_above IS NOT NULL"), "conv_id")
            .select(F.col("_above").alias("conv_id"), (F.col("_top") - 1).alias("depth"), "leaves", "saved")
            .groupBy("conv_id", "depth").agg(*sums), "going")
        if going.isEmpty():
            break
        arrived = stored(arrived.unionByName(going).groupBy("conv_id", "depth").agg(*sums), "arrived")
    arrived = arrived.withColumn("_stretch", F.floor(F.col("depth") / stretch))
    below = Window.partitionBy("conv_id").orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    deeper = arrived.groupBy("conv_id", "_stretch").agg(*sums).select(
        "conv_id", "_stretch", F.coalesce(F.sum("leaves").over(below), zero).alias("_leaves"),
        F.coalesce(F.sum("saved").over(below), zero).alias("_saved"))
    inside = Window.partitionBy("conv_id", "_stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return arrived.join(deeper, ["conv_id", "_stretch"]).select(
        "conv_id", "depth", (F.sum("leaves").over(inside) + F.col("_leaves")).alias("n_leaves"),
        (F.sum("saved").over(inside) + F.col("_saved")).alias("saved_tokens"))


def end_digests(paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """``(node, ends_sha256)``: digest of the ids, ascending and comma-joined, of the conversations that end at a node.

    Ids are sorted over all tasks and joined to pieces there. A digest is a chain by definition, so the pieces of one node
    pass one task one after the other; it holds one of them at a time.
    """
    n = compute_partitions(paths.sparkSession)
    ends = paths.where("depth = length").select("node", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        node, first, ids, size = None, 0, [], 0
        for batch in batches:
            for at, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if at != node or size > piece:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, first, ids, size = at, conv_id, [], 0
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
            if out:
                yield _rows(out)
                out = []
        if ids:
            yield _rows([(node, first, ",".join(ids))])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        nodes, firsts, texts = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, chain = None, None
        for batch in batches:
            out: list[tuple] = []
            for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if at != node:
                    if chain is not None:
                        out.append((node, chain.hexdigest()))
                    node, chain = at, hashlib.sha256()
                else:
                    chain.update(b",")
                chain.update(ids.encode())
            yield _digests(out)
        if chain is not None:
            yield _digests([(node, chain.hexdigest())])

    def _digests(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["node", "ends_sha256"])

    pieces = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        join, "node binary, first long, ids string")
    return pieces.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(
        digest, "node binary, ends_sha256 string")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """Nodes with their counts and, from their parents, ``parent_conv_id``."""
    nodes = stored(paths.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight")), "nodes")
    counts = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    parents = stored(
        counts.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"), "parents")
    placed = nodes.join(parents.select(F.col("parent").alias("node"), "n_children"), "node", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    named = lookup(stored(placed, "placed"), parents.withColumnRenamed("n_children", "_n"), "parent", "_n")
    return named.drop("parent", "_n").withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).withColumn(
        "leaf", (F.col("n_children") == 0).cast("int"))


def prefix_trie(turns: DataFrame, unit: int = UNIT, run: int = RUN, stretch: int = STRETCH) -> DataFrame:
    """One row per node ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    ``turns(conv_id, turn, role, text)``; other columns are ignored. Turns go by ``turn``, null first; equal ones by
    the digest of role and text, so repeated rows are turns of their own in a fixed order. Null role and text are
    empty. Rows without a ``conv_id`` belong to no conversation; no turns give no nodes. A node whose subtree holds more than ``unit`` turns
    is above the shards; every other node is in the shard of its highest ancestor that is not.
    """
    turns = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("_role"),
        F.coalesce("text", F.lit("")).alias("_text"))
    turns = stored(named_turns(turns), "named")
    convs = stored(conversations(turns), "convs")
    paths = stored(rebuilt_paths(turns, convs), "paths")
    is_heavy = (F.col("weight") > unit) | (F.col("depth") == 0)
    nodes = stored(trie_nodes(paths).withColumn("heavy", is_heavy), "trie")
    heavy = nodes.where("heavy")
    above = paths.join(small_or_same(heavy.select("node")), "node", "left_semi").groupBy("conv_id").agg(
        (F.max("depth") + 1).alias("depth"))
    units = paths.join(above, ["conv_id", "depth"]).select("conv_id", F.col("node").alias("unit"), F.col("depth").alias("_cut"))
    light = nodes.where("NOT heavy").join(units, "conv_id").withColumn("is_root", F.col("depth") == F.col("_cut"))
    shards = stored(shard_totals(light, run), "shards")
    messages = shards.where("is_root").select(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"),
        F.col("saved_tokens").alias("saved"))
    top = heavy.join(root_totals(heavy, messages, stretch), ["conv_id", "depth"])
    columns = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    done = shards.select(*columns).unionByName(top.select(*columns))
    empty = hashlib.sha256(b"").hexdigest()
    return done.join(end_digests(paths), "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).drop("node")


#: The crc32 is worked out bit by bit; a node's ancestors are the prefixes of its smallest member.
SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS b, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r0 AS (SELECT c, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.b WHERE pos < h
  UNION ALL SELECT c, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.c WHERE pos >= h),
r1 AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, sha256(strlen(role)::VARCHAR || ':' || role || text) AS k,
  strlen(text) AS nb FROM r0),
r AS (SELECT c, d, sha256(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS node, nb FROM r1
  UNION ALL SELECT c, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT node, d, min(c) AS c, count(*) AS n_convs, max(nb) AS nb FROM r GROUP BY node, d),
p AS MATERIALIZED (SELECT n.node, n.d, n.c, n_convs, (n_convs - 1) * n.nb AS saved, r.node AS up FROM n LEFT JOIN r ON r.c = n.c AND r.d = n.d - 1),
k AS (SELECT up, count(*) AS n_children FROM p WHERE up IS NOT NULL GROUP BY up),
q AS MATERIALIZED (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN k ON k.up = p.node),
s AS (SELECT r.node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM q JOIN r ON r.c = q.c AND r.d <= q.d GROUP BY r.node),
e AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM r WHERE (c, d) IN (SELECT (c, max(d)) FROM r GROUP BY c) GROUP BY node)
SELECT q.c AS conv_id, q.d AS depth, u.c AS parent_conv_id, q.n_convs, q.n_children, n_leaves, saved_tokens,
  coalesce(ends, sha256('')) AS ends_sha256
FROM q JOIN s ON s.node = q.node LEFT JOIN n u ON u.node = q.up LEFT JOIN e ON e.node = q.node
"""
