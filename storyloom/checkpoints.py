"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the files of a query's shuffles go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own where that is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="storyloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def _ending(frame: DataFrame, action):
    """action of frame, whose shuffles leave no files: else they stay until the driver happens to collect its garbage.

    A plan of its own runs, so that frame can be used again.
    """
    conf = frame.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return action(frame.select("*"))
    finally:
        conf.set(CLEANUP, before)


def checkpoint(frame: DataFrame) -> DataFrame:
    shared_folder(frame.sparkSession)
    return _ending(frame, lambda own: own.checkpoint())


def stored(frame: DataFrame) -> DataFrame:
    """frame as a Parquet table of the shared folder: for wide rows, of which a checkpoint takes several times the disk and is always read whole."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    _ending(frame, lambda own: own.write.parquet(path))
    return spark.read.schema(frame.schema).parquet(path)
