"""Cutting lineage of small tables that iterative jobs read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Without it a cluster session is an error, and only a session whose executors run on this machine, as in
    tests, gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
        if folder is None and context.master.split("[")[0] != "local":
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="claimlab-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a table to the checkpoint folder and read it from there; it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
