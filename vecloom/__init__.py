"""Vector analytics on Spark: vectors, labels, shards, codes and graph edges are DataFrames."""

from pyspark import cloudpickle

import sys

# Functions handed to executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULTS = {
    # Default parameters of the graph and the quantizer.
    "alpha": 1.2,
    "max_candidates": 750,
    "slack": 1.3,
    "degree": 64,
    "build_list": 100,
    "search_list": 100,
    "pq_centers": 256,
    "pq_max_chunks": 512,
    "pq_train_rows": 256_000,
    "pq_reps": 12,
    "opq_rounds": 20,
    "opq_reps": 8,
    "rerank_multiplier": 3,
    "partition_reps": 10,
    "partition_start": 3,
    "k_base": 2,
}
