"""Shared scratch space: where checkpoints and read-back tables go.

A cluster names its shared folder in ``spark.checkpoint.dir``; that setting is
always honoured. Only a local-mode session without the setting (tests, laptops)
falls back to a fresh temporary folder. A cluster session without it is an
error, since a machine-local folder is lost with the machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that outlives single executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    folder = tempfile.mkdtemp(prefix="recon-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "rows") -> DataFrame:
    """Compute once into a table on shared storage and read it back.

    Later stages start from the written files, so a lost executor costs a
    re-read, not a recomputation, and each reader takes only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
