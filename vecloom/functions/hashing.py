"""Seeded pseudo-random order that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_order(seed: int, *cols: str) -> Column:
    """Hex digest of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
