"""The given tables in the shapes the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.plans.sums import vector_means


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as ``(id, vec)``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as ``(qid, qvec)``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with norms 1 to 7, as the given ones all have norm 1."""
    return vectors(spark, sf_dir).withColumn(
        "vec", F.transform("vec", lambda x: x.cast("double") * (1 + F.col("id") % 7)))


def int8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn(
        "vec", F.transform("vec", lambda x: F.round(x.cast("double") * 127).cast("tinyint")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vec, labels)``: class label, by_3 / by_5 by id, and the universal ``all`` on every 50th."""
    v = F.col("vec_id")
    maybe = F.array(
        F.concat(F.lit("l"), F.col("label").cast("string")),
        F.when(v % 3 == 0, F.lit("by_3")), F.when(v % 5 == 0, F.lit("by_5")), F.when(v % 50 == 0, F.lit("all")),
    )
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.col("embedding").alias("vec"), F.filter(maybe, lambda x: x.isNotNull()).alias("labels"))


def class_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cid, vec)``: mean vector of each class label over the whole table."""
    means = vector_means(table(spark, sf_dir, "embeddings").withColumn("cid", F.col("label").cast("long")), "cid", "embedding")
    return means.select("cid", "vec")


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, labels)``: language and source of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("labels"))


def r6(c):
    """Rounded for comparison; adding 0 turns -0 into 0."""
    return F.round(c, 6) + F.lit(0.0)


def shown(results: DataFrame) -> DataFrame:
    """Results with rank as a long and the distance rounded."""
    return results.withColumn("rank", F.col("rank").cast("long")).withColumn("dist", r6("dist"))


# The same inputs in SQL, as common table expressions.
SQL_VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
SQL_SCALED = "s AS (SELECT id, list_transform(vec, lambda x: x * (1 + id % 7)) AS vec FROM v)"
SQL_LABELLED = (
    "pl AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, list_filter(["
    "'l' || label::VARCHAR, CASE WHEN vec_id % 3 = 0 THEN 'by_3' END, CASE WHEN vec_id % 5 = 0 THEN 'by_5' END, "
    "CASE WHEN vec_id % 50 = 0 THEN 'all' END], lambda x: x IS NOT NULL) AS labels FROM embeddings)"
)
SQL_ELEMENTS = "el AS (SELECT id, label, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM v)"
SQL_CENTERS = (
    SQL_ELEMENTS + ", c AS (SELECT cid, list(m ORDER BY pos) AS vec FROM "
    "(SELECT label::BIGINT AS cid, pos, avg(x) AS m FROM el GROUP BY label, pos) GROUP BY cid)"
)
SQL_L2 = "list_distance({a}, {b}) ** 2"
SQL_DOC_LABELS = "dl AS (SELECT doc_id AS id, [lang, source] AS labels FROM documents)"


def topk_sql(pairs: str, k: int, extra: str = "") -> str:
    """Rank ``pairs(qid, id, dist)`` per query by (dist, id)."""
    return (
        f"SELECT qid, rank, id, round(dist, 6) AS dist{extra} FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM ({pairs})) WHERE rank <= {k}"
    )
