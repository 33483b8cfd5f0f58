"""Joins of vectors with queries in bounded blocks.

Both sides are cut into cells by a hash of their ids, so a hot group (one label or one shard with
a third of all rows) becomes many cells of equal size. Each cell meets each query cell of its group
once, inside a matrix product; only the wanted pairs leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import Block, longs, matrix, rank_in_group
from .scratch import compute_partitions, fetch_bounded, small_or_same

BASE_CELL = 32_768        # base rows per cell
QUERY_CELL = 16_384       # query rows per cell at most: few cells would leave tasks idle, many would copy the base often
LEAST_CELL = 256          # query rows per cell at least
CELLS_PER_TASK = 4        # cells for each partition, where the rows allow
HIT_ROWS = 65_536         # pairs of a range join that leave a task at a time
BROADCAST_ROWS = 4_096    # a side of at most so many rows ...
BROADCAST_BYTES = 32 << 20  # ... and bytes is sent to every task

Rows = Callable[[pa.Table], np.ndarray]


def vec_rows(table: pa.Table) -> np.ndarray:
    return matrix(table.column("vec"))


def _pairs(q_ids, b_ids, dist) -> pa.Table:
    return pa.table({
        "qid": pa.array(q_ids, pa.int64()),
        "id": pa.array(b_ids, pa.int64()),
        "dist": pa.array(dist, pa.float64()),
    })


def _hits(q_ids, n) -> pa.Table:
    return pa.table({"qid": pa.array(q_ids[n > 0], pa.int64()), "hits": pa.array(n[n > 0], pa.int64())})


def _score(block: Block, q_ids, q, k, radius, skip_same, counted=None) -> pa.Table:
    if counted is not None:
        return _hits(q_ids, block.count_within(q_ids, q, radius, counted, skip_same))
    if k is not None:
        qi, bi, d = block.nearest(q_ids, q, k, skip_same)
    else:
        qi, bi, d = block.within(q_ids, q, radius, skip_same)
    return _pairs(q_ids[qi], block.ids[bi], d)


def _hit_batches(block: Block, q_ids, q, radius, skip_same) -> Iterator[pa.RecordBatch]:
    """All pairs within the radius, a bounded number at a time."""
    for qi, bi, d in block.within_parts(q_ids, q, radius, skip_same):
        yield from _pairs(q_ids[qi], block.ids[bi], d).to_batches(HIT_ROWS)


def small_queries(queries: DataFrame):
    """Ids and matrix of the query side when its size allows sending it everywhere."""
    table = fetch_bounded(queries.select("qid", "qvec"), BROADCAST_ROWS)
    if table is None or table.num_rows == 0:
        return None
    q = matrix(table.column("qvec"))
    return (longs(table.column("qid")), q) if q.nbytes <= BROADCAST_BYTES else None


def scan_pairs(
    base: DataFrame, sent, metric: str, k: int | None = None, radius: float | None = None,
    skip_same: bool = False, rows: Rows = vec_rows, counted: int | None = None,
) -> DataFrame:
    """Pairs of every base row with a small, size-checked query set; the base is not shuffled.

    For top-k every task keeps one running list per query. ``counted`` as in ``cell_pairs``.
    """
    held = base.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = held.value
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            block = Block(longs(table.column("id")), rows(table), metric)
            if k is None and counted is None:
                yield from _hit_batches(block, q_ids, q, radius, skip_same)
                continue
            found = _score(block, q_ids, q, k, radius, skip_same, counted)
            if k is None:
                yield from found.to_batches()
                continue
            best = found if best is None else pa.concat_tables([best, found])
            if best.num_rows > 4 * k * len(q_ids):
                best = _trim(best, k)
        if best is not None:
            yield from _trim(best, k).combine_chunks().to_batches()

    return base.mapInArrow(run, "qid long, id long, dist double" if counted is None else "qid long, hits long")


def _trim(found: pa.Table, k: int) -> pa.Table:
    qid, ids = longs(found.column("qid")), longs(found.column("id"))
    d = found.column("dist").to_numpy()
    order = np.lexsort((ids, d, qid))
    qid, ids, d = qid[order], ids[order], d[order]
    keep = rank_in_group(qid) < k
    return _pairs(qid[keep], ids[keep], d[keep])


def cell_pairs(
    base: DataFrame, queries: DataFrame, metric: str, k: int | None = None, radius: float | None = None,
    by: str | None = None, skip_same: bool = False, rows: Rows = vec_rows,
    base_cell: int = BASE_CELL, query_cell: int = QUERY_CELL, keep_group: bool = False, counted: int | None = None,
) -> DataFrame:
    """Pairs of base and query rows of the same group ``by`` (or of all rows), cell by cell.

    ``keep_group`` adds the group to each pair. With ``counted`` there are no pairs but parts of counts ``(qid, hits)``,
    of those within ``radius`` once their distance is rounded to so many decimals.
    """
    group = by or "_all"
    if by is None:
        base, queries = base.withColumn(group, F.lit(0)), queries.withColumn(group, F.lit(0))
    n = compute_partitions(base.sparkSession)
    sizes = small_or_same(
        base.groupBy(group).agg(F.count(F.lit(1)).alias("_nb"))
        .join(queries.groupBy(group).agg(F.count(F.lit(1)).alias("_nq")), group)
    )
    base_cells = F.ceil(F.col("_nb") / base_cell)
    # Rows of the query cells of a group, so that all groups together have some cells for each partition.
    pairs = sizes.agg(F.sum(F.col("_nb").cast("double") * F.col("_nq"))).first()[0] or 0.0
    wanted = F.lit(pairs / (CELLS_PER_TASK * n)) * base_cells / F.col("_nb")
    rows_each = F.greatest(F.lit(min(LEAST_CELL, query_cell)), F.least(F.lit(query_cell), F.ceil(wanted)))
    cells = sizes.select(
        group, base_cells.cast("int").alias("_base_cells"), F.ceil(F.col("_nq") / rows_each).cast("int").alias("_query_cells"))
    left = (
        base.join(cells, group)
        .withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_base_cells")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_query_cells") - 1)))
        .drop("_base_cells", "_query_cells")
    )
    right = (
        queries.join(cells, group)
        .withColumn("_q", F.pmod(F.xxhash64("qid"), F.col("_query_cells")).cast("int"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_base_cells") - 1)))
        # new column names: both sides may come from one table
        .select(F.col(group).alias("_q_group"), F.col("_b").alias("_q_b"), F.col("_q").alias("_q_q"), "qid", "qvec")
    )

    if k is None and counted is None and not keep_group:
        return _cell_hits(left, right, group, metric, radius, skip_same, rows)

    def score(key, b, q):
        if b.num_rows == 0 or q.num_rows == 0:
            found = _pairs([], [], []) if counted is None else _hits(np.empty(0, np.int64), np.empty(0, np.int64))
        else:
            block = Block(longs(b.column("id")), rows(b), metric)
            found = _score(block, longs(q.column("qid")), matrix(q.column("qvec")), k, radius, skip_same, counted)
        if keep_group:
            found = found.append_column(group, pa.array([key[0].as_py()] * found.num_rows, key[0].type))
        return found

    schema = T.StructType([
        T.StructField("qid", T.LongType()),
        *([T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType())] if counted is None else [T.StructField("hits", T.LongType())])])
    if keep_group:
        schema.add(T.StructField(group, base.schema[group].dataType))
    # A fixed number of partitions: cells are few bytes but much arithmetic, and would be coalesced.
    mine, theirs = [group, "_b", "_q"], ["_q_group", "_q_b", "_q_q"]
    return (
        left.repartition(n, *mine).groupBy(*mine)
        .cogroup(right.repartition(n, *theirs).groupBy(*theirs))
        .applyInArrow(score, schema)
    )


def _cell_hits(left: DataFrame, right: DataFrame, group: str, metric: str, radius: float, skip_same: bool, rows: Rows) -> DataFrame:
    """Pairs within the radius, cell by cell: a cell's base rows come first, its queries pass by, and hits leave at once.

    The hits of a cell may be all its pairs, so they are never held together.
    """
    payload = [c for c in left.columns if c not in (group, "_b", "_q", "id")]
    side = left.select(F.col(group).alias("_g"), "_b", "_q", F.lit(False).alias("_asks"), "id", *payload, F.lit(None).cast(
        right.schema["qvec"].dataType).alias("qvec"))
    other = right.select(F.col("_q_group").alias("_g"), F.col("_q_b").alias("_b"), F.col("_q_q").alias("_q"), F.lit(True).alias("_asks"),
                         F.col("qid").alias("id"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in payload], "qvec")
    keys = ["_g", "_b", "_q"]
    placed = side.unionByName(other).repartition(compute_partitions(left.sparkSession), *keys).sortWithinPartitions(*keys, "_asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, base, block = None, [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            ends = 1 + np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
            for a, e in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
                now = tuple(c[a] for c in columns[:3])
                if now != cell:
                    cell, base, block = now, [], None
                part = pa.Table.from_batches([batch.slice(a, e - a)])
                if not columns[3][a]:
                    base.append(part)
                elif base:
                    if block is None:
                        table = pa.concat_tables(base)
                        block = Block(longs(table.column("id")), rows(table), metric)
                        base = [part.slice(0, 0)]
                    yield from _hit_batches(block, longs(part.column("id")), matrix(part.column("qvec")), radius, skip_same)

    return placed.mapInArrow(run, "qid long, id long, dist double")


def nearest_of_small(
    df: DataFrame, sent, metric: str, k: int, id_col: str, vec_col: str,
    keep: list[str], out_id: str = "cid", rank: str = "rank", dist: str = "dist",
) -> DataFrame:
    """For each row its k nearest of a small, size-checked set; no shuffle at all.

    Adds ``out_id``, ``rank`` (from 1) and ``dist``; keeps the columns ``keep``.
    """
    held = df.sparkSession.sparkContext.broadcast(sent)
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField(out_id, T.LongType()), T.StructField(rank, T.IntegerType()),
           T.StructField(dist, T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = held.value
        block = Block(ids, rows, metric)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows == 0:
                continue
            at = np.arange(table.num_rows)
            qi, bi, d = block.nearest(at, matrix(table.column(vec_col)), k)
            out = table.select(keep).take(pa.array(qi))
            out = out.append_column(out_id, pa.array(block.ids[bi], pa.int64()))
            out = out.append_column(rank, pa.array(rank_in_group(qi) + 1, pa.int32()))
            out = out.append_column(dist, pa.array(d, pa.float64()))
            yield from out.combine_chunks().to_batches()

    wanted = list(dict.fromkeys([*keep, id_col, vec_col]))
    return df.select(*wanted).mapInArrow(run, schema)
