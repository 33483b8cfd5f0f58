"""Joins that dress results: tags, vectors, codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_tags(results: DataFrame, tags: DataFrame) -> DataFrame:
    """Attach the user's ``tag`` to result ids; ids without one keep NULL."""
    return results.join(tags.select("id", "tag"), "id", "left")


def with_vectors(results: DataFrame, base: DataFrame) -> DataFrame:
    return results.join(base.select("id", "vec"), "id")


def get_by_tag(points: DataFrame, tags: DataFrame) -> DataFrame:
    """Vectors of the asked ``tag`` values with ``status`` 0, or -1 where the tag is unknown."""
    found = points.select("tag", "vec", F.lit(0).alias("status"))
    return (
        tags.select("tag").join(found, "tag", "left")
        .select("tag", "vec", F.coalesce("status", F.lit(-1)).alias("status"))
    )


def get_codes(codes: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").join(codes.select("id", "codes"), "id")
