"""Shared storage: tables that cut the lineage, readable by every executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session names none (tests), since other machines can't read it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        path = tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder; any executor can read it again. The session's compression holds where none is named."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/treeline-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
