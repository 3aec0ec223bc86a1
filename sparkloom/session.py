"""A session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """UTC times, adaptive execution with skew handling, and ``partitions`` shuffle partitions.
    On a cluster set ``partitions`` to two or three times the cores, ``spark.checkpoint.dir``
    to a folder all executors share, and leave the rest to adaptive execution."""
    builder = SparkSession.builder.master(master).appName("sparkloom")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its files give work to under half of them, as one small file
    does; larger inputs are left as they lie, so nothing is shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
