"""Intermediate tables in shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder in shared storage: under the session's checkpoint
    directory (the context's, else ``spark.checkpoint.dir``), else under the
    warehouse directory, which a cluster must place in shared storage too."""
    base = (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.sql.warehouse.dir"))
    return f"{base.rstrip('/')}/foldwise-scratch/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to shared scratch storage and read back: cuts lineage, and
    a lost executor costs only a reread."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
