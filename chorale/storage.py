"""The folder that driver and executors share, and cuts of lineage in it."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a folder of our own serves in local mode only; on a cluster no
    other machine would see it, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='chorale-')}")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Of a query that is made and run within this, the shuffles' files go as soon as it ends; otherwise they lie on the disks until
    the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drained(df: DataFrame) -> DataFrame:
    """``durable``, after which the shuffles below the cut are gone too."""
    with dropped_shuffles(df.sparkSession):
        return durable(df.select("*"))
