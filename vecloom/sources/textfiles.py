"""Text forms: tab-separated vectors and label files whose line i is point i."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import number_rows


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(id, value)``: lines numbered from 0 in file order.

    Lines keep their order by file, split and place in the split; the offsets come from counts.
    """
    lines = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_in_task"))
    )
    return number_rows(lines, ["_file", "_block", "_in_task"], "id").select("id", "value")


def read_tsv(spark: SparkSession, path: str, dim: int | None = None, sep: str = "\t") -> DataFrame:
    """``(id, vec)`` from one vector per line; with ``dim`` another width is an error."""
    rows = _lines(spark, path).where(F.length(F.trim("value")) > 0).select(
        "id", F.transform(F.split(F.trim("value"), sep), lambda x: x.cast("float")).alias("vec"))
    if dim is None:
        return rows
    return rows.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(
        F.raise_error(F.concat(F.lit("row of another width than "), F.lit(str(dim))))))


def write_tsv(df: DataFrame, path: str, sep: str = "\t") -> None:
    """One line per vector in id order."""
    text = F.array_join(F.transform("vec", lambda x: x.cast("string")), sep)
    df.orderBy("id").select(text.alias("value")).write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(id, labels)``: commas separate labels; a TAB ends the field and line ends are dropped."""
    field = F.split(F.regexp_replace("value", "[\\r\\n]", ""), "\t")[0]
    labels = F.filter(F.split(field, ","), lambda x: x != "")
    return _lines(spark, path).select("id", F.array_sort(labels).alias("labels"))


def write_labels(df: DataFrame, path: str) -> None:
    """Line i holds the labels of the i-th point in id order."""
    df.orderBy("id").select(F.array_join("labels", ",").alias("value")).write.mode("overwrite").text(path)
