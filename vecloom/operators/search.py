"""Batched best-first search over an edge table.

An index that is small by rows and bytes, both checked, goes to the queries: each task walks its own ones to the end,
and nothing is shuffled. Otherwise all queries walk together. One round joins the points each query expands with their neighbours,
drops what the query has seen, joins the rest with their vectors (or codes), and merges distances
into the query's list. A query is one row; its list has at most L entries. The state is written to
the shared folder after each round, and finished queries leave the loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import DEFAULTS
from ..functions.distances import distance
from ..functions.validate import list_size
from ..plans.arrays import longs, matrix, one_array, pair_distance, rank_in_group
from ..plans.blocks import small_queries
from ..plans.held import HELD_BYTES, HELD_ROWS, Shelf, fetch_held, held_matrix, shelved
from ..plans.scratch import compute_partitions, drop_folder, small_or_same, stored
from .graph import adjacency
from .knn import merge_topk, rank_results
from .labels import labels_match

QUERIES_PER_CALL = 64
MAX_ENTRIES = 1_000
FIRST_HOP_ROWS = 10_000  # start points and their neighbours are sent to every task up to this many
SEEN_CELLS = 1 << 25      # queries times points that a task marks as seen at a time
HELD_PAIRS = 16_384       # pairs scored at a time
LISTS = 65_536            # neighbour lists turned into positions at a time
FRESH, EXPANDED, CHOSEN = 0, 1, 2

STATE = (
    "qid long, qvec array<double>, L int, ids array<long>, dists array<double>, marks array<tinyint>, "
    "chosen array<long>, seen array<long>, trail array<long>, trail_dists array<double>, n_cmps long, n_rounds int"
)
WALKED = "qid long, L int, ids array<long>, dists array<double>, trail array<long>, trail_dists array<double>, n_cmps long, n_rounds int"


@dataclass
class Walk:
    """What a search leaves behind."""

    state: DataFrame

    @property
    def lists(self) -> DataFrame:
        """``(qid, id, dist)``: the whole list of each query."""
        pairs = self.state.select("qid", F.explode(F.arrays_zip("ids", "dists")).alias("p"))
        return pairs.select("qid", F.col("p.ids").alias("id"), F.col("p.dists").alias("dist"))

    @property
    def trace(self) -> DataFrame:
        """``(qid, hop, id, dist)``: expanded points in order, hop from 0."""
        pairs = self.state.select("qid", F.posexplode(F.arrays_zip("trail", "trail_dists")).alias("hop", "p"))
        return pairs.select("qid", "hop", F.col("p.trail").alias("id"), F.col("p.trail_dists").alias("dist"))

    @property
    def stats(self) -> DataFrame:
        """``(qid, L, n_cmps, n_hops, n_rounds)`` per query."""
        return self.state.select("qid", "L", "n_cmps", F.size("trail").alias("n_hops"), "n_rounds")

    def results(self, k: int, skip_same: bool = False) -> DataFrame:
        found = self.lists
        return rank_results(found.where("qid <> id") if skip_same else found, k)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each element of a list column."""
    column = one_array(column)
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _lists(at: np.ndarray, values: np.ndarray, n: int, value_type: pa.DataType) -> pa.ListArray:
    """List column of n rows from values sorted by row."""
    offsets = np.r_[0, np.cumsum(np.bincount(at, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, value_type))


def _append(column, at: np.ndarray, values: np.ndarray, value_type: pa.DataType) -> pa.ListArray:
    old_at, old = _flat(column)
    both = np.r_[old_at, at].astype(np.int64)
    order = np.argsort(both, kind="stable")
    return _lists(both[order], np.r_[old, values][order], len(column), value_type)


def _distances(metric: str, book, payload, q: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distance of each payload row (vector, or codes of ``book``) to its owner's query."""
    if book is None:
        x = matrix(payload)
    else:
        q, x = book.sides(metric, q, matrix(payload, np.int64))
    return np.concatenate([
        pair_distance(metric, q[owner[s:s + 65536]], x[s:s + 65536]) for s in range(0, len(x), 65536)])


def _score_here(metric: str, book, sent):
    """Map ``(scored_for, id, payload)`` to distances where the payload is, for a small query set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            owner = np.searchsorted(qids, longs(table.column("scored_for")))
            d = _distances(metric, book, table.column("payload"), q, owner)
            yield from table.select(["scored_for", "id"]).append_column("dist", pa.array(d)).to_batches()

    return run


def _advance(metric: str, W: int, book):
    """Merge scored points into the lists of a few queries and choose what each expands next."""

    def step(key, state, scored):
        n = state.num_rows
        if n == 0:
            return state.select([f.split()[0] for f in STATE.split(", ")])
        qids = longs(state.column("qid"))
        by_id = np.argsort(qids)
        owner = by_id[np.searchsorted(qids, longs(scored.column("scored_for")), sorter=by_id)] if scored.num_rows else np.empty(0, np.int64)
        ids = longs(scored.column("id"))
        if scored.num_rows == 0:
            d = np.empty(0)
        elif "dist" in scored.column_names:
            d = one_array(scored.column("dist")).to_numpy(zero_copy_only=False)
        else:
            d = _distances(metric, book, scored.column("payload"), matrix(state.column("qvec")), owner)
        old_at, old_ids = _flat(state.column("ids"))
        _, old_d = _flat(state.column("dists"))
        _, old_marks = _flat(state.column("marks"))
        expanded = old_marks == CHOSEN
        trail = _append(state.column("trail"), old_at[expanded], old_ids[expanded], pa.int64())
        trail_dists = _append(state.column("trail_dists"), old_at[expanded], old_d[expanded], pa.float64())
        seen = _append(state.column("seen"), owner, ids, pa.int64())

        good = ~np.isnan(d)
        at = np.r_[old_at, owner[good]].astype(np.int64)
        all_ids = np.r_[old_ids, ids[good]].astype(np.int64)
        all_d = np.r_[old_d, d[good]].astype(float)
        marks = np.r_[np.where(expanded, EXPANDED, old_marks), np.zeros(good.sum(), np.int8)].astype(np.int8)
        order = np.lexsort((all_ids, all_d, at))
        at, all_ids, all_d, marks = at[order], all_ids[order], all_d[order], marks[order]
        keep = rank_in_group(at) < one_array(state.column("L")).to_numpy()[at]
        at, all_ids, all_d, marks = at[keep], all_ids[keep], all_d[keep], marks[keep]
        fresh = np.flatnonzero(marks == FRESH)
        picked = fresh[rank_in_group(at[fresh]) < W]
        marks[picked] = CHOSEN
        return pa.table({
            "qid": state.column("qid"), "qvec": state.column("qvec"), "L": state.column("L"),
            "ids": _lists(at, all_ids, n, pa.int64()), "dists": _lists(at, all_d, n, pa.float64()),
            "marks": _lists(at, marks, n, pa.int8()), "chosen": _lists(at[picked], all_ids[picked], n, pa.int64()),
            "seen": seen, "trail": trail, "trail_dists": trail_dists,
            "n_cmps": pa.array(longs(state.column("n_cmps")) + np.bincount(owner, minlength=n), pa.int64()),
            "n_rounds": pa.array(one_array(state.column("n_rounds")).to_numpy() + 1, pa.int32()),
        })

    return step


@dataclass
class _Index:
    """A whole index as arrays, points in id order; neighbours are positions, and so are the carriers of each label."""

    ids: np.ndarray
    payload: np.ndarray
    offsets: np.ndarray
    nbrs: np.ndarray
    carriers: dict | None

    def at(self, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and positions of the ids that the index holds."""
        if len(self.ids) == 0 or len(ids) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        where = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        known = self.ids[where] == ids
        return owner[known], where[known]

    def around(self, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and positions of the neighbours of all these ids."""
        return self.near(*self.at(owner, ids))

    def near(self, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and positions of the neighbours of all these positions."""
        n = self.offsets[at + 1] - self.offsets[at]
        flat = np.repeat(self.offsets[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(owner, n), self.nbrs[flat].astype(np.int64)

    def new(self, owner: np.ndarray, at: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each (owner, position) once, by owner and position, without those that the owner has seen."""
        n = max(1, len(self.ids))
        key = owner * n + at
        key = np.sort(key[~seen[key]])
        return np.divmod(key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key, n)

    def closed(self, label, universal) -> np.ndarray:
        """Which points a query with this label may not enter."""
        out = np.ones(len(self.ids), bool)
        for name in [label] if universal is None else [label, universal]:
            out[self.carriers.get(name, np.empty(0, np.int64))] = False
        return out

    def distances(self, metric: str, book, q: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distance of each position to its owner's query."""
        out = np.empty(len(at))
        for s in range(0, len(at), HELD_PAIRS):
            x, left = self.payload[at[s:s + HELD_PAIRS]], q
            if book is None:
                x = x.astype(np.float64)
            else:
                left, x = book.sides(metric, q, x.astype(np.int64))
            out[s:s + HELD_PAIRS] = pair_distance(metric, left[owner[s:s + HELD_PAIRS]], x)
        return out


def _held_index(graph: DataFrame, nodes: DataFrame, filtered: bool, held_rows: int) -> tuple[str, dict | None] | None:
    """Folder with the index as arrays, and the carriers of each label, if its size allows; else None."""
    found = fetch_held(nodes, "payload", held_rows)
    if found is None:
        return None
    table, order = found
    size = graph.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("nbrs")).alias("edges")).first()
    if size.n > held_rows or 8 * (size.edges or 0) > HELD_BYTES:
        return None
    shelf = Shelf(graph.sparkSession, "index")
    if held_matrix(shelf, "payload", table.column("payload"), order) is None:
        return None
    ids = longs(table.column("id"))[order]
    shelf.put("ids", ids)
    carriers = _carriers(table.column("labels").take(pa.array(order))) if filtered else None
    del found, table, order  # the vectors are on the shelf
    lists = graph.select(F.col("src").cast("long").alias("src"), F.col("nbrs").cast("array<long>").alias("nbrs")).toArrow()
    src, batches = longs(lists.column("src")), lists.to_batches(LISTS)
    known, kept = np.isin(src, ids), np.zeros(len(src), np.int64)

    def ends() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and positions of the neighbours that the index holds, some lists at a time."""
        first = 0
        for batch in batches:
            at, flat = _flat(batch.column(1))
            at = at + first
            first += batch.num_rows
            flat = flat.astype(np.int64)
            end = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            held = (ids[end] == flat) & known[at]
            yield at[held], end[held]

    for at, _ in ends():
        kept += np.bincount(at, minlength=len(src))
    by_src, starts = np.argsort(src, kind="stable"), np.empty(len(src), np.int64)
    starts[by_src] = np.cumsum(kept[by_src]) - kept[by_src]
    degree = np.zeros(len(ids), np.int64)
    np.add.at(degree, np.searchsorted(ids, src[known]), kept[known])
    nbrs = shelf.room("nbrs", (int(kept.sum()),), np.int32)
    for at, end in ends():
        nbrs[starts[at] + rank_in_group(at)] = end
    shelf.put("offsets", np.r_[0, np.cumsum(degree)])
    return shelf.close(), carriers


def _carriers(labels) -> dict:
    """Rows with each label."""
    labels = one_array(labels)
    at = np.repeat(np.arange(len(labels)), np.diff(labels.offsets.to_numpy()))
    coded = labels.flatten().dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    return dict(zip(coded.dictionary.to_pylist(), np.split(at[order], ends[:-1]))) if len(ends) else {}


def _walk_held(index: _Index, q, sizes, owner, at, seen, metric: str, W: int, book, max_rounds):
    """Whole walks of a few queries, all in step, from the positions ``at``; points marked in ``seen`` are not entered.

    Lists and trails as ``(row, position, distance)`` by row, and the points scored and the rounds of each.
    """
    m, n = len(q), max(1, len(index.ids))
    seen = seen.reshape(-1)
    row = place = np.empty(0, np.int64)
    dist, marks = np.empty(0), np.empty(0, np.int8)
    ended, trail = [], []
    n_cmps, n_rounds, going, rounds = np.zeros(m, np.int64), np.zeros(m, np.int32), np.ones(m, bool), 0
    while True:
        seen[owner * n + at] = True
        d = index.distances(metric, book, q, owner, at)
        n_cmps += np.bincount(owner, minlength=m)
        n_rounds[going] += 1
        took = marks == CHOSEN
        trail.append((row[took], place[took], dist[took]))
        marks[took] = EXPANDED
        held = np.bincount(row, minlength=m)
        full, last = (held >= sizes) & (held > 0), np.cumsum(held) - 1
        worst = np.full(m, np.inf)
        worst[full] = dist[last[full]]
        good = d <= worst[owner]  # what is not a number falls out, too
        row, place, dist = np.r_[row, owner[good]], np.r_[place, at[good]], np.r_[dist, d[good]]
        marks = np.r_[marks, np.zeros(good.sum(), np.int8)]
        order = np.lexsort((place, dist, row))
        order = order[rank_in_group(row[order]) < sizes[row[order]]]
        row, place, dist, marks = row[order], place[order], dist[order], marks[order]
        fresh = np.flatnonzero(marks == FRESH)
        picked = fresh[rank_in_group(row[fresh]) < W]
        marks[picked] = CHOSEN
        going = np.zeros(m, bool)
        if max_rounds is None or rounds < max_rounds:
            going[row[picked]] = True
        stays = going[row]
        ended.append((row[~stays], place[~stays], dist[~stays]))
        if not going.any():
            return *(_by_row(parts) for parts in (ended, trail)), n_cmps, n_rounds
        row, place, dist, marks = row[stays], place[stays], dist[stays], marks[stays]
        chosen = marks == CHOSEN
        owner, at = index.new(*index.near(row[chosen], place[chosen]), seen)
        rounds += 1


def _by_row(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, place, dist = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(row, kind="stable")
    return row[order], place[order], dist[order]


def _walk_here(sent, metric: str, W: int, book, universal, max_rounds):
    """Whole walks of a few queries at a time, over an index held as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, carriers = sent.value
        arrays = shelved(path)
        index = _Index(*(arrays[name] for name in ("ids", "payload", "offsets", "nbrs")), carriers)
        step = max(1, min(QUERIES_PER_CALL, SEEN_CELLS // max(1, len(index.ids))))
        seen = np.empty((step, len(index.ids)), bool)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                yield walk(index, seen, batch.slice(a, step))

    def walk(index: _Index, seen: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        m = part.num_rows
        seen = seen[:m]
        seen[:] = False
        if index.carriers is not None:
            wanted = part.column("label").to_pylist()
            for label in set(wanted):
                seen[[i for i, w in enumerate(wanted) if w == label]] = index.closed(label, universal)
        qids = longs(part.column("qid"))
        owner, at = index.new(*index.at(*_flat(part.column("fresh"))), seen.reshape(-1))
        by_id = np.argsort(qids)
        owner = by_id[np.searchsorted(qids, qids[owner], sorter=by_id)]  # of rows that share a qid one walks, as in the joined walk
        lists, trail, n_cmps, n_rounds = _walk_held(
            index, matrix(part.column("qvec")), one_array(part.column("L")).to_numpy(), owner, at, seen, metric, W, book, max_rounds)
        out = {"qid": part.column("qid"), "L": part.column("L")}
        for names, (row, place, dist) in ((("ids", "dists"), lists), (("trail", "trail_dists"), trail)):
            out[names[0]] = _lists(row, index.ids[place], m, pa.int64())
            out[names[1]] = _lists(row, dist, m, pa.float64())
        return pa.RecordBatch.from_pydict({**out, "n_cmps": pa.array(n_cmps), "n_rounds": pa.array(n_rounds)})

    return run


def graph_search(
    edges: DataFrame, nodes: DataFrame, queries: DataFrame, entries: DataFrame, k: int,
    L: int | None = DEFAULTS["search_list"], *, W: int = 32, metric: str = "l2", starts: DataFrame | None = None,
    universal: str | None = None, quantizer=None, max_rounds: int | None = None, held_rows: int = HELD_ROWS,
) -> Walk:
    """Walk ``edges(src, dst)`` (or ``(src, nbrs)``) from ``entries(id)`` for ``queries(qid, qvec)``.

    ``nodes(id, vec[, labels])``, or ``nodes(id, codes)`` with a ``quantizer``. Queries with a
    ``label`` enter only points that match it, also from ``starts(label, starts)``; a label without
    a start is an error unless there is a ``universal`` label. ``L=None`` reads a column ``L`` of
    the queries. ``W`` points per query are expanded in a round. An index of at most ``held_rows`` points and HELD_BYTES
    is walked inside the tasks; the answers and counts are those of the joined walk.
    """
    if L is not None:
        queries = queries.withColumn("L", F.lit(list_size(k, L)))
    payload = "vec" if quantizer is None else "codes"
    filtered = "label" in queries.columns
    graph = edges if "nbrs" in edges.columns else stored(adjacency(edges), "adjacency")
    nodes = nodes.select("id", F.col(payload).alias("payload"), *(["labels"] if filtered else []))
    book = quantizer.arrays() if quantizer is not None else None

    queries = stored(queries.withColumn("qvec", F.col("qvec").cast("array<double>")), "queries")
    n_queries = queries.count()
    calls = max(1, -(-n_queries // QUERIES_PER_CALL))
    general = [r.id for r in entries.select("id").distinct().limit(MAX_ENTRIES + 1).collect()]
    if len(general) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entry points; give label starts through `starts`")
    first = queries.select("qid", F.array(*[F.lit(i).cast("long") for i in general]).alias("fresh"))
    if filtered and starts is not None:
        starts = small_or_same(starts)
        known = queries.select("qid", "label").join(starts, "label", "left")
        if universal is None and not known.where("starts IS NULL").isEmpty():
            raise ValueError("a query label has no start point")
        first = known.select(
            "qid", F.array_union(F.array(*[F.lit(i).cast("long") for i in general]),
                                 F.coalesce("starts", F.array().cast("array<long>"))).alias("fresh"))
    first = stored(first, "first")
    empty_long, empty_double = F.array().cast("array<long>"), F.array().cast("array<double>")
    parts = compute_partitions(queries.sparkSession)
    held = _held_index(graph, nodes, filtered, held_rows)
    if held is not None:
        sent_index = queries.sparkSession.sparkContext.broadcast(held)
        asked = queries.select("qid", "qvec", F.col("L").cast("int").alias("L")).join(first, "qid")
        if filtered:
            asked = asked.join(queries.select("qid", "label"), "qid")
        run = _walk_here(sent_index, metric, W, book, universal, max_rounds)
        walked = stored(asked.repartition(parts, "qid").mapInArrow(run, WALKED), "walk")
        drop_folder(queries.sparkSession, held[0])
        return Walk(walked)
    state = queries.select(
        "qid", "qvec", F.col("L").cast("int").alias("L"), empty_long.alias("ids"), empty_double.alias("dists"),
        F.array().cast("array<tinyint>").alias("marks"), empty_long.alias("chosen"), empty_long.alias("seen"),
        empty_long.alias("trail"), empty_double.alias("trail_dists"), F.lit(0).cast("long").alias("n_cmps"),
        F.lit(0).alias("n_rounds"),
    )
    step = _advance(metric, W, book)
    start_ids = first.select(F.explode("fresh").alias("id")).distinct()
    near_nodes = small_or_same(nodes.join(start_ids, "id", "left_semi"), FIRST_HOP_ROWS)
    near_graph = small_or_same(graph.join(start_ids, graph.src == start_ids.id, "left_semi"), FIRST_HOP_ROWS)
    labels = small_or_same(queries.select("qid", "label")) if filtered else None

    # Few queries go to where the vectors are, so only distances travel; the vectors of many
    # queries' neighbours travel to the queries.
    sent = small_queries(queries)
    if sent is not None:
        order = np.argsort(sent[0])
        sent = queries.sparkSession.sparkContext.broadcast((sent[0][order], sent[1][order]))

    def bucket(qid: str):
        return F.pmod(F.xxhash64(qid), F.lit(calls)).cast("int")

    def move(state: DataFrame, fresh: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
        """The next state, and how many queries still have points to expand."""
        pairs = fresh.select("qid", F.explode("fresh").alias("id"))
        scored = pairs.join(nodes, "id")
        if filtered:
            scored = scored.join(labels, "qid").where(labels_match(F.col("labels"), F.array("label"), universal))
        scored = scored.select(F.col("qid").alias("scored_for"), "id", "payload")
        if sent is not None:
            scored = scored.mapInArrow(_score_here(metric, book, sent), "scored_for long, id long, dist double")
        seen = Observation()
        moved = (
            state.withColumn("bucket", bucket("qid")).repartition(parts, "bucket").groupBy("bucket")
            .cogroup(scored.withColumn("for_bucket", bucket("scored_for")).repartition(parts, "for_bucket").groupBy("for_bucket"))
            .applyInArrow(step, STATE).observe(seen, F.count_if(F.size("chosen") > 0).alias("active"))
        )
        moved = stored(moved, "walk")
        return moved, seen.get["active"]

    placed = nodes.limit(FIRST_HOP_ROWS + 1).count() > FIRST_HOP_ROWS
    if placed:
        # Placed by key once: the rounds then move only their own rows, not these tables.
        graph = graph.repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
        nodes = nodes.repartition(parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
    done: list[DataFrame] = []
    state, n_active = move(state, first, near_nodes)
    rounds = 0
    while True:
        done.append(state.where(F.size("chosen") == 0))
        active = state.where(F.size("chosen") > 0)
        if n_active == 0:
            break
        if max_rounds is not None and rounds >= max_rounds:
            done.append(active)
            break
        around = (
            active.select("qid", F.explode("chosen").alias("src"))
            # the first hop starts from few points that every query shares: join it by broadcast
            .join(near_graph if rounds == 0 else graph, "src")
            .groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("around"))
        )
        fresh = around.join(active.select("qid", "seen"), "qid").select(
            "qid", F.array_except("around", "seen").alias("fresh"))
        reach = nodes
        if rounds == 0:
            reach = small_or_same(nodes.join(
                near_graph.select(F.explode("nbrs").alias("id")).distinct(), "id", "left_semi"), FIRST_HOP_ROWS)
        state, n_active = move(active, fresh, reach)
        rounds += 1
    if placed:
        graph.unpersist()
        nodes.unpersist()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return Walk(out)


def search_live(walk: Walk, live: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
    """Results with tags: points without a live tag are walked over but not returned."""
    found = walk.lists.join(live.select("id", "tag"), "id")
    if skip_same:
        found = found.where("qid <> id")
    ranked = rank_results(found, k)
    return ranked.join(live.select("id", "tag"), "id").select("qid", "rank", "id", "dist", "tag")


def beam_search(
    edges: DataFrame, codes: DataFrame, base: DataFrame, queries: DataFrame, entries: DataFrame, quantizer, k: int,
    L: int = DEFAULTS["search_list"], W: int = 4, max_rounds: int | None = None, skip_same: bool = False, metric: str = "l2",
) -> tuple[DataFrame, Walk]:
    """Walk by code distances, then rank the expanded points by their full vectors."""
    walk = graph_search(edges, codes, queries, entries, k, L, W=W, metric=metric, quantizer=quantizer, max_rounds=max_rounds)
    pairs = walk.trace.select("qid", "id").distinct()
    if skip_same:
        pairs = pairs.where("qid <> id")
    scored = (
        pairs.join(base.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
        .select("qid", "id", distance(metric, "vec", "qvec").alias("dist"))
    )
    return rank_results(scored, k), walk


def graph_range_search(
    edges: DataFrame, nodes: DataFrame, queries: DataFrame, entries: DataFrame, radius: float, min_L: int, max_L: int,
    *, W: int = 16, metric: str = "l2", skip_same: bool = False,
) -> DataFrame:
    """``(qid, id, dist)`` within the radius; the list doubles while half of it or more is inside."""
    graph = edges if "nbrs" in edges.columns else stored(adjacency(edges), "adjacency")
    found = None
    L = min_L
    while True:
        walk = graph_search(graph, nodes, queries, entries, 1, L, W=W, metric=metric)
        inside = walk.lists.where(F.col("dist") <= radius)
        hits = inside.groupBy("qid").agg(F.count(F.lit(1)).alias("_hits"))
        again = hits.where(F.col("_hits") >= L / 2).select("qid")
        last = L >= max_L
        part = inside if last else inside.join(again, "qid", "left_anti")
        found = part if found is None else found.unionByName(part)
        if last:
            break
        queries = stored(queries.join(again, "qid", "left_semi"), "unfinished")
        if queries.isEmpty():
            break
        L = min(2 * L, max_L)
    return found.where("qid <> id") if skip_same else found


def sweep(
    edges: DataFrame, nodes: DataFrame, queries: DataFrame, entries: DataFrame, k: int, Ls: list[int],
    *, W: int = 16, metric: str = "l2", skip_same: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Results ``(L, qid, rank, id, dist)`` and stats for several list sizes in one walk; L < k is skipped."""
    Ls = [n for n in Ls if n >= k]
    sizes = F.array(*[F.lit(n) for n in Ls])
    asked = queries.select(
        F.col("qid").alias("_q"), "qvec", F.posexplode(sizes).alias("_n", "L")
    ).select((F.col("_q") * len(Ls) + F.col("_n")).alias("qid"), "qvec", "L")
    walk = graph_search(edges, nodes, asked, entries, k, None, W=W, metric=metric)

    def split(df: DataFrame) -> DataFrame:
        n = F.pmod("qid", F.lit(len(Ls))).cast("int")
        return df.withColumn("L", F.element_at(sizes, n + 1)).withColumn("qid", F.floor(F.col("qid") / len(Ls)).cast("long"))

    lists = walk.lists
    if skip_same:
        lists = lists.where(F.floor(F.col("qid") / len(Ls)) != F.col("id"))
    return split(rank_results(lists, k)).select("L", "qid", "rank", "id", "dist"), split(walk.stats)


def multi_search(indexes: list[tuple[DataFrame, DataFrame, DataFrame]], queries: DataFrame, k: int, L: int, **options) -> DataFrame:
    """Search several ``(edges, nodes, entries)`` and merge; an id held by several counts once."""
    parts = [graph_search(e, n, queries, s, k, L, **options).results(k) for e, n, s in indexes]
    return merge_topk(parts, k, distinct_ids=True)
