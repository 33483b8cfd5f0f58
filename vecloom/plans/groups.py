"""Runs of whole groups through Arrow, without one Python call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import compute_partitions


def map_sorted_groups(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.Table], schema: T.StructType,
) -> DataFrame:
    """Hash ``df`` by ``keys``, sort by keys and ``order``, and call ``fn`` on tables of complete groups.

    Only the last, unfinished group of an Arrow batch is carried over, so memory holds one batch
    and one group. Callers bound the group size. When a window has already placed the rows this
    way, Spark drops the shuffle and the sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []
        carried_key = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            last = tuple(c[-1] for c in columns)
            others = np.flatnonzero(np.logical_or.reduce([c != v for c, v in zip(columns, last)]))
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut == 0:
                if carried and carried_key != last:
                    yield from fn(pa.Table.from_batches(carried)).to_batches()
                    carried = []
                carried.append(batch)
            else:
                carried.append(batch.slice(0, cut))
                yield from fn(pa.Table.from_batches(carried)).to_batches()
                carried = [batch.slice(cut)]
            carried_key = last
        if carried:
            yield from fn(pa.Table.from_batches(carried)).to_batches()

    n = compute_partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
