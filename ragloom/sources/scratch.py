"""Tables that several passes share, written once below spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        path = "file://" + tempfile.mkdtemp(prefix="spark-ragloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/ragloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
