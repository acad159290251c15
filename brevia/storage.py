"""Where queries write files of their own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where the session names none, under a temporary
    one in local mode; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="brevia-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/brevia-files/{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what reads it doesn't go back to df's inputs."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
