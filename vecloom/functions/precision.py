"""What is lost when vectors are stored as half or bfloat16."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.arrays import matrix


def _bf16(x: np.ndarray) -> np.ndarray:
    """float32 rounded to the nearest bfloat16 (ties to even), as float32."""
    bits = x.view(np.uint32)
    rounded = bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))
    return (rounded & np.uint32(0xFFFF0000)).view(np.float32)


def narrow_vec(df: DataFrame, to: str, col: str = "vec") -> DataFrame:
    """Round each float through ``f16`` or ``bf16`` and store it as float again."""
    from ..plans.arrays import list_column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.schema.get_field_index(col)
            x = matrix(batch.column(at), np.float32)
            with np.errstate(over="ignore"):
                y = x.astype(np.float16).astype(np.float32) if to == "f16" else _bf16(x)
            yield batch.set_column(at, col, list_column(y, pa.float32()))

    if to not in ("f16", "bf16"):
        raise ValueError(f"unknown narrow type {to!r}")
    out = df.withColumn(col, F.col(col).cast("array<float>"))
    return out.mapInArrow(run, out.schema)


def halfprec_report(df: DataFrame, col: str = "vec") -> DataFrame:
    """One row: values seen, which format is nearer how often, overflows, largest and mean errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column(0), np.float32).reshape(-1)
            with np.errstate(over="ignore", invalid="ignore"):
                f16, bf = x.astype(np.float16).astype(np.float32), _bf16(x)
                e16 = np.abs(f16.astype(np.float64) - x)
                ebf = np.abs(bf.astype(np.float64) - x)
            wins = int((e16 < ebf).sum())
            yield pa.RecordBatch.from_pydict({
                "n": [x.size], "f16_wins": [wins], "bf16_wins": [x.size - wins],
                "f16_overflow": [int(np.isinf(f16).sum())], "bf16_overflow": [int(np.isinf(bf).sum())],
                "f16_max": [float(e16.max())], "bf16_max": [float(ebf.max())],
                "f16_sum": [float(e16.sum())], "bf16_sum": [float(ebf.sum())],
            })

    counts = ("n", "f16_wins", "bf16_wins", "f16_overflow", "bf16_overflow")
    schema = ", ".join([f"{c} long" for c in counts] + [f"{c} double" for c in ("f16_max", "bf16_max", "f16_sum", "bf16_sum")])
    return df.select(col).mapInArrow(run, schema).agg(
        *[F.sum(c).alias(c) for c in counts],
        F.max("f16_max").alias("f16_max_error"), F.max("bf16_max").alias("bf16_max_error"),
        (F.sum("f16_sum") / F.sum("n")).alias("f16_mean_error"),
        (F.sum("bf16_sum") / F.sum("n")).alias("bf16_mean_error"),
    )
