"""Stable sharding through a permutation-filled lookup table, DataFrame functions only."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the registered query: a prime with over 100 slots per shard keeps shards within about one percent.
SHARDS, TABLE_SIZE = 32, 3203


def _number(name: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:12], 16)


def fill_table(names: list[str], size: int) -> list[int]:
    """Owner of each of ``size`` slots (a prime, so every step visits all slots).

    Each shard prefers the slots ``offset, offset + step, offset + 2 step, ...``; the shards take turns, each
    claiming its next free slot. The table depends on the names and the size alone, never on data.
    """
    if not names or len(names) > size or len(set(names)) != len(names):
        raise ValueError("shards need different names, at least one and at most one per slot")
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"{size} is no prime")
    at = [_number(n, "offset") % size for n in names]
    step = [_number(n, "step") % (size - 1) + 1 for n in names]
    owner, left = [-1] * size, size
    while left:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(size: int, *cols: str) -> Column:
    """Slot of a key: 48 bits of the md5 of its columns as text; nulls are a value of their own."""
    key = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") % size


def lookup_table(spark: SparkSession, names: list[str], size: int) -> DataFrame:
    """``(slot, shard)``, ``size`` rows."""
    owners = F.from_json(F.lit(json.dumps(fill_table(names, size))), "array<bigint>")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard")).withColumn("slot", F.col("slot").cast("long"))


def assign_shards(docs: DataFrame, names: list[str], size: int = 65_537, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``, the place of its key; columns of these names are replaced.

    One map over the rows: the table has ``size`` rows, a parameter, so it is broadcast. Equal keys share
    a shard, repeated rows included; a null key has a fixed slot; no rows give no rows. Leaving a shard
    out moves its own keys and few others.
    """
    rows = docs.drop("shard").withColumn("slot", slot_of(size, *key))
    return rows.join(F.broadcast(lookup_table(docs.sparkSession, names, size)), "slot")


def write_shards(docs: DataFrame, path: str, names: list[str], size: int = 65_537, key: tuple[str, ...] = ("doc_id",)) -> None:
    """Write a folder ``shard=<n>`` per shard, straight from the tasks that read the rows."""
    assign_shards(docs, names, size, key).drop("slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def names_of(n: int) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


#: The turns as a recursive query: ``used`` marks the claimed slots, ``slot`` is the claim of this turn.
SQL = f"""
WITH RECURSIVE s AS (
  SELECT i, ('0x' || substr(md5('offset|shard-' || i), 1, 12))::BIGINT % {TABLE_SIZE} AS first_slot,
         ('0x' || substr(md5('step|shard-' || i), 1, 12))::BIGINT % ({TABLE_SIZE} - 1) + 1 AS stride
  FROM range({SHARDS}) r(i)),
p AS (SELECT list(list_transform(range({TABLE_SIZE}), lambda j: (first_slot + j * stride) % {TABLE_SIZE}) ORDER BY i) AS prefs FROM s),
fill AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, list_transform(range({TABLE_SIZE}), lambda j: false) AS used FROM p
  UNION ALL
  SELECT turn + 1, claim, list_transform(used, lambda u, k: u OR k = claim + 1) FROM (
    SELECT turn, used, list_filter(prefs[turn % {SHARDS} + 1], lambda x: NOT used[x + 1])[1] AS claim
    FROM fill, p WHERE turn < {TABLE_SIZE})),
owner AS (SELECT slot, (turn - 1) % {SHARDS} AS shard FROM fill WHERE turn > 0)
SELECT doc_id, slot, shard::BIGINT AS shard FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, 'null')), 1, 12))::BIGINT % {TABLE_SIZE} AS slot
  FROM documents) JOIN owner USING (slot)
"""
