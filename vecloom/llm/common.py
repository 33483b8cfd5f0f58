"""What the text operators share: words, seeded hashes and joins that survive one key with a third of all rows."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def seeded_hash(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """``left`` with the columns of ``right`` (one row per ``key``, ``weight`` of its rows in ``left``); left outer.

    Keys with at least 1/``share`` of all weight, of which there are at most ``share``, are broadcast;
    the others meet in a shuffle in which no key is large. Both sides are read twice, so pass stored tables.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share >= F.lit(total)
    many = right.where(hot)
    served = left.join(F.broadcast(many), key)
    rest = left.join(F.broadcast(many.select(key)), key, "left_anti")
    return served.unionByName(rest.join(right.where(~hot), key, "left"))


class Ids(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def words_of(text) -> list[bytes]:
    """Words of a text as bytes, A-Z lower-cased; None has none. Splits at space and 0x09-0x0D only."""
    return text.lower().split() if text else []


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list:
    """The texts of a batch as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary()).to_pylist()


def indexed(texts: list, ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, and where each text starts (one entry more than texts)."""
    lists = [words_of(t) for t in texts]
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(w) for w in lists], out=starts[1:])
    out = np.empty(int(starts[-1]), np.int64)
    look = ids.__getitem__
    for a, words in zip(starts.tolist(), lists):
        out[a:a + len(words)] = np.fromiter(map(look, words), np.int64, len(words))
    return out, starts


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``max_bytes``, at least one row each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes // max(1, batch.nbytes)))
        for a in range(0, n, step):
            yield batch.slice(a, step)


def process_cache(name: str) -> dict:
    """A dict that the tasks of one Python worker share; only for values that can be made again."""
    module = sys.modules.setdefault("_vecloom_process_cache", types.ModuleType("_vecloom_process_cache"))
    return module.__dict__.setdefault(name, {})


def give_back(name: str) -> None:
    """Empty a process cache: called by tasks that have no use for it, as a worker may come from others that had."""
    process_cache(name).clear()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of every i, in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
