"""The folder that driver and executors share, and frames that are written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets one; a cluster needs it."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{given or 'file://' + tempfile.mkdtemp(prefix='docweave-')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a path, and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
