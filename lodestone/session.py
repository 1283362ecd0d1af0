"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on.

    Joins carry no broadcast hints unless the code bounds the hinted side; adaptive execution picks
    broadcast joins from measured sizes and splits skewed join partitions.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Long texts: a batch of the default 10,000 rows would hold tens of megabytes in every worker.
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if spark.sparkContext.master.startswith("local"):
        conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return path or current.get()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
