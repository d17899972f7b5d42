"""Session settings the plans are written for; all can be set on a running session."""

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # Runtime sizes pick the join strategy, merge small partitions and split hot ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot admission even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort a join side once every partition of it is known to be this
    # small; equal to the default advisory partition size, below which it has no effect.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    """Set them, leaving shuffle width, broadcast bounds and paths to the cluster."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
