"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only where it is
    unset and all work is on this machine, as in tests, is a temporary folder made; elsewhere that is
    an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark, "_sparkloom_folder", None)
        if not folder:
            folder = spark._sparkloom_folder = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def _removed(spark: SparkSession, path: str) -> None:
    """Delete a staged table; nothing happens when the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: lineage is cut and a
    lost executor loses nothing. The table is removed when the driver's process ends, or before by
    ``clear``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[tuple[SparkSession, str]] = []


def clear() -> None:
    """Remove the tables staged so far; call it when the results that read them are written."""
    while _STAGED:
        _removed(*_STAGED.pop())


atexit.register(clear)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def connected(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each connected component, for the nodes that
    occur in ``links``. Alternating large-star and small-star steps; each round is written to
    the shared folder, and a node with many neighbours sends aggregates, never a list. It
    needs rounds in the order of the logarithm of the longest path; more than ``rounds``
    raises an error rather than give parts of components."""
    from pyspark.sql import functions as F

    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
