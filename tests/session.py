"""Local session for tests, the oracle check and the bench (not used by the library)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="foldwise-", dir="/tmp")
    spark = (SparkSession.builder.master(f"local[{cores}]")
             .appName("foldwise-tests")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.local.dir", os.path.join(scratch, "local"))
             .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        # only tests set their own; a cluster names a shared folder itself
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "checkpoints"))
    return spark
