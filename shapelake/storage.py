"""The folder that all executors share, and cutting lineage in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or the context's checkpoint folder. A local session without one, as in tests, gets its own; a cluster raises."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    kept = context._jsc.sc().getCheckpointDir()
    if not found and kept.isDefined():
        found = kept.get()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shapelake-")
    if not kept.isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"


def saved(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
