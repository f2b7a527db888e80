"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where a local session names none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if found:
        if held.isEmpty():
            sc.setCheckpointDir(found)
        return found
    if held.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="aerolith-"))
    return sc._jsc.sc().getCheckpointDir().get()


def workspace(spark: SparkSession, name: str) -> str:
    """A folder name of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df as a checkpoint: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
