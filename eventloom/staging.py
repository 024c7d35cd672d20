"""Cutting lineage by a reliable checkpoint in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_dir(spark: SparkSession) -> str:
    """A temporary folder for local masters; on a cluster the executors would not see it."""
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="eventloom-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to ``spark.checkpoint.dir``; where none is configured, a local master chooses a folder and a cluster refuses."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(found or local_dir(df.sparkSession))
    return df.checkpoint()
