"""Tables written and read again, so that no lineage grows, in the folder that all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleanspark-")
    return found.rstrip("/")


def written(df: DataFrame, folder: str, *by: str) -> DataFrame:
    """df, with a folder for each value of `by` where that is given."""
    path = os.path.join(folder, f"gleanspark-{uuid.uuid4().hex}")
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)
