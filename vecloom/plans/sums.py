"""Sums of vectors per group, pre-added in Arrow batches before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import list_column, matrix, one_array


def group_sums(df: DataFrame, key_type: T.DataType, key: str, partial: Callable) -> DataFrame:
    """``(key, sums ARRAY<DOUBLE>)``: element-wise totals of what ``partial`` yields per batch.

    ``partial(table) -> (keys, matrix)`` gives at most one row per key of its batch.
    """
    schema = T.StructType([T.StructField(key, key_type), T.StructField("part", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, sums = partial(pa.Table.from_batches([batch]))
                yield pa.RecordBatch.from_arrays([keys, list_column(sums, pa.float64())], [key, "part"])

    cells = df.mapInArrow(run, schema).select(key, F.posexplode("part").alias("pos", "x"))
    return (
        cells.groupBy(key, "pos").agg(F.sum("x").alias("x"))
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_cells"))
        .select(key, F.transform("_cells", lambda c: c["x"]).alias("sums"))
    )


def add_rows(at: np.ndarray, n_keys: int, rows: np.ndarray) -> np.ndarray:
    """Sum rows by key number."""
    order = np.argsort(at, kind="stable")
    out = np.zeros((n_keys, rows.shape[1]))
    starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    out[at[order][starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def vector_means(df: DataFrame, by: str, vec: str = "vec", out: str = "vec") -> DataFrame:
    """``(by, out, n)``: mean vector and row count per value of ``by``."""

    def partial(table: pa.Table):
        coded = one_array(table.column(by)).dictionary_encode()
        rows = matrix(table.column(vec))
        rows = np.hstack([rows, np.ones((len(rows), 1))])
        return coded.dictionary, add_rows(coded.indices.to_numpy(), len(coded.dictionary), rows)

    sums = group_sums(df.where(F.col(by).isNotNull()).select(by, vec), df.schema[by].dataType, by, partial)
    n = F.element_at("sums", -1)
    return sums.select(
        by,
        F.transform(F.slice("sums", 1, F.size("sums") - 1), lambda x: x / n).alias(out),
        n.cast("long").alias("n"),
    )
