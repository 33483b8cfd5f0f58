"""Vectors of a checked size that every task sees as arrays instead of joining them.

The arrays lie in the shared folder. Where that is a folder of the machine, tasks map them into memory, so however many
workers an executor has, it holds them once; elsewhere each task reads them.
"""

from __future__ import annotations

import io
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import longs
from .scratch import fetch_bounded, new_path

HELD_ROWS, HELD_BYTES = 1 << 20, 384 << 20  # rows up to this size are given to the tasks
ITEM = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4}  # bytes of a value


def filesystem(path: str):
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:", "file://", 1)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class Shelf:
    """A new folder of arrays in the shared folder."""

    def __init__(self, spark: SparkSession, name: str = "held"):
        self.path, self.spark = new_path(spark, name), spark
        self.fs, self.where = filesystem(self.path)
        self.fs.create_dir(self.where)
        self.near = self.where if isinstance(self.fs, pafs.LocalFileSystem) else tempfile.mkdtemp(prefix="vecloom-")

    def room(self, name: str, shape: tuple, dtype) -> np.ndarray:
        """An array to be filled, which takes no memory of its own."""
        return np.lib.format.open_memmap(f"{self.near}/{name}.npy", "w+", dtype, shape)

    def put(self, name: str, values: np.ndarray) -> None:
        np.save(f"{self.near}/{name}.npy", np.ascontiguousarray(values))

    def close(self) -> str:
        """The folder's path, once all arrays are filled."""
        if self.near != self.where:
            for name in os.listdir(self.near):
                pafs.copy_files(f"{self.near}/{name}", f"{self.where}/{name}", pafs.LocalFileSystem(), self.fs)
                os.remove(f"{self.near}/{name}")
        return self.path


def shelved(path: str) -> dict[str, np.ndarray]:
    """The arrays of a folder by name."""
    fs, where = filesystem(path)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(where)):
        name = info.base_name.removesuffix(".npy")
        if isinstance(fs, pafs.LocalFileSystem):
            out[name] = np.load(info.path, mmap_mode="r")
        else:
            with fs.open_input_file(info.path) as f:
                out[name] = np.load(io.BytesIO(f.read()))
    return out


def fetch_held(df: DataFrame, payload: str, held_rows: int = HELD_ROWS) -> tuple[pa.Table, np.ndarray] | None:
    """``df(id, payload, ...)`` and its order by id if its size allows, else None; a large one is given up after a bounded look."""
    head = df.select(F.size(payload).alias("dim")).first() if held_rows else None
    if head is None:
        return None
    item = ITEM.get(df.schema[payload].dataType.elementType.simpleString(), 8)
    table = fetch_bounded(df, min(held_rows, HELD_BYTES // (item * max(1, head.dim or 1))))
    if table is None or table.nbytes > HELD_BYTES or table.column("id").null_count:
        return None
    return table, np.argsort(longs(table.column("id")), kind="stable")


def held_matrix(shelf: Shelf, name: str, column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray | None:
    """Rows of a list column in this order in their own type, or None if they are not all there and of one width."""
    chunks = [c for c in column.chunks if len(c)]
    widths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks] or [np.empty(0, np.int64)])
    if column.null_count or not len(widths) or (widths != widths[0]).any():
        return None
    kind = np.dtype(column.type.value_type.to_pandas_dtype())
    if kind.kind in "iu" and any(c.flatten().null_count for c in chunks):
        kind = np.dtype(np.float64)  # a value that is not there is not a number
    place, at = np.empty(len(order), np.int64), 0
    place[order] = np.arange(len(order))
    out = shelf.room(name, (len(order), int(widths[0])), kind)
    for c in chunks:
        out[place[at:at + len(c)]] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        at += len(c)
    return out
