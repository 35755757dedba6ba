"""A session with the settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Time texts carry no zone and count as UTC.
    "spark.sql.session.timeZone": "UTC",
    # Sizes shuffle partitions at run time and splits skewed joins.
    "spark.sql.adaptive.enabled": "true",
    # Everything follows one shuffle, so a small partition still carries much work.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Rows arrive at the list aggregates in key order, from the windows before them: a sort
    # aggregate passes through, a hash aggregate would sort again beyond its first few keys.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is set a local session gets one of its own; on a cluster that is an error, as a folder
    of one machine would lose rows with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tripfold-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def kept(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder now, so that what follows sees the same ones in any case."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
