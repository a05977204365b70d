"""Python workers and this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship() -> None:
    """Lets Python workers of a local master import this package; a cluster gets it with --py-files."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the driver ends; a local master may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", shared)
    folder = f"{shared}/files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df computed once, into a table in a new folder: later plans read it there, also after a lost executor."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
