import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """300 points of 12 dimensions: a third are copies of one point, a third carry one hot label."""
    import numpy as np
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 12)).round(3)
    x[:100] = x[0]
    rows = []
    for n, v in enumerate(x.tolist()):
        labels = ["hot"] if 100 <= n < 200 else [f"l{n % 5}"]
        if n % 60 == 7:
            labels.append("all")
        rows.append((n, v, labels))
    df = spark.createDataFrame(rows, "id long, vec array<double>, labels array<string>")
    df = df.repartition(4).cache()
    return df, x, [r[2] for r in rows]
