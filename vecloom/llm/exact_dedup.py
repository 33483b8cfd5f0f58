"""Exact dedup in three combining steps that compare whole texts, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import SPACES, lookup
from vecloom.plans.scratch import stored


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combined(rows: DataFrame, salts: int) -> DataFrame:
    """``(_digest, keep_id, group_size, _text)``: one row per text.

    1. Each input task merges its own rows of equal (digest, text) before anything is shuffled.
    2. These partial groups meet under (digest, salt), the salt being the input task's number, so a text
       found in every task is spread over ``salts`` groups.
    3. The at most ``salts`` winners of a text meet under its digest.
    The text itself is a grouping key in each step: equal digests alone never merge two rows.
    """
    merged = (
        rows.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_digest", "_salt", "_text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return merged.groupBy("_digest", "_text").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when identical after each run of white space (space, 0x09-0x0D) became one space; a null
    text is empty. The smallest doc_id of equal texts stays. Rows repeated with one doc_id are one document:
    they share the flag and count singly in ``group_size``. A null doc_id loses to every other; in a group
    of null ids only, ``keep_id`` is null and none is kept. No rows give no rows; other columns are ignored.

    ``digest`` places the rows. Should one digest stand for several texts, its rows are joined on the text too.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    groups = stored(
        combined(rows, salts).select("_digest", sha256(F.col("_text")).alias("_sha"), "keep_id", "group_size"), "exact")
    keys = stored(rows.select("doc_id", "_digest"), "exact")
    several = groups.groupBy("_digest").count().where("count > 1").select("_digest")
    if several.isEmpty():
        out = lookup(keys, groups, "_digest", "group_size")
    else:
        several = stored(several, "exact")
        alone = lookup(
            keys.join(several, "_digest", "left_anti"), groups.join(several, "_digest", "left_anti"), "_digest", "group_size")
        clashing = rows.join(several, "_digest", "left_semi").withColumn("_sha", sha256(F.col("_text")))
        named = stored(
            combined(clashing.drop("_sha"), salts).withColumn("_sha", sha256(F.col("_text"))), "exact")
        together = clashing.join(named.drop("_digest", "_sha"), "_text")
        out = alone.unionByName(together.select(alone.columns))
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(n) AS text_sha256
FROM t JOIN g USING (n)
"""
